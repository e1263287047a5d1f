import uuid

import pytest
from pyspark.sql import functions as F
from stratalens.functions import hashing, text


def values(spark, column, *given):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_strip_and_collapse(spark):
    odd = ["  a b ", " a ", "\x1fa\x1c", "a\n\n b\t", "", "　"]
    assert values(spark, text.strip, *odd) == [x.strip() for x in odd]
    assert values(spark, text.collapse, *odd) == [" ".join(x.split()) for x in odd]


def test_names(spark):
    got = values(spark, text.parsed_name, "FS_PA_Disbursement_R14.docx", "fs_a_R007_Final v2.docx", "FS_A_R1x_R02.docx", "FS_É_R٣.docx")
    assert [(g.document_family, g.release_label, g.variant_suffix) for g in got[:3]] == [("FS_PA_Disbursement", "R14", None), ("fs_a", "R7", "Final v2"), ("FS_A_R1x", "R2", None)]
    assert values(spark, text.stem, "a", "x.y_R1.docx", ".docx") == ["a", "x.y_R1", ".docx"]
    with pytest.raises(Exception, match="Unsupported document filename"):
        values(spark, text.parsed_name, "Specification R1.docx")


def test_noise(spark):
    noise = ["", "  ", "Document Control", "1.1\tBackground\t9", "2. Scope of work\t12", " Versioning rules", "x World Headquarters y", "Authorization matrix"]
    clean = ["document control", "1.1 Background 9", "Details", "The Version is new"]
    assert values(spark, text.is_noise, *noise, *clean) == [True] * len(noise) + [False] * len(clean)


def test_keys(spark):
    assert len(set(values(spark, hashing.content_hash, "a\nb", "a\r\nb", "a\rb"))) == 1
    keys = ["k", "0" * 64, "é"]
    assert values(spark, hashing.point_id, *keys) == [str(uuid.uuid5(uuid.NAMESPACE_URL, k)) for k in keys]
