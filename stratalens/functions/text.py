"""Text rules as columns: edges and inner white space, file names, boilerplate paragraphs.

White space is Unicode white space and the separators U+001C to U+001F.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
#: The same characters one by one, for trimming without a regular expression.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Family, release number and suffix of a document's stem; a line of a table of contents.
NAME = r"(?iUd)^(FS_[^\s]+?)_R(\d+)(_.+)?$"
TOC_LINE = r"(?Ud)^(\d+(\.\d+)*)\.?[\s\x1c-\x1f]+.+\t\d+$"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def collapse(x: Column) -> Column:
    """Runs of white space as one space, none at the edges."""
    return strip(F.regexp_replace(x, rf"(?U){SPACE}+", " "))


def stem(file_name: Column) -> Column:
    """The name without its last suffix."""
    return F.regexp_extract(file_name, r"(?s)^(.+?)(\.[^.]+)?$", 1)


def parsed_name(file_name: Column) -> Column:
    """document_name, document_family, release_label, release_number, variant_suffix, source_type; fails on other names."""
    name = stem(file_name)
    part = lambda i: F.regexp_extract(name, NAME, i)
    number = part(2).try_cast("long") if hasattr(Column, "try_cast") else part(2).cast("long")
    fail = F.raise_error(F.concat(F.lit("Unsupported document filename: "), F.coalesce(file_name, F.lit("null"))))
    found = F.struct(
        name.alias("document_name"), part(1).alias("document_family"), F.concat(F.lit("R"), number).alias("release_label"),
        number.alias("release_number"), F.nullif(F.substring(part(3), 2, 2**30), F.lit("")).alias("variant_suffix"), F.lit("docx").alias("source_type"),
    )
    return F.when(name.rlike(NAME), found).otherwise(fail.cast(
        "struct<document_name:string,document_family:string,release_label:string,release_number:bigint,variant_suffix:string,source_type:string>"
    ))


@dataclass(frozen=True)
class NoiseRules:
    """Paragraphs that are boilerplate; matching is case-sensitive and on stripped text."""

    exact: tuple[str, ...]
    headings: tuple[str, ...]
    prefixes: tuple[str, ...]
    parts: tuple[str, ...]


# The default boilerplate rules.
DEFAULT_NOISE = NoiseRules(
    exact=(
        "You can delete any elements of this cover page that you do not need for your document.",
        "To add additional approval lines, press [Tab] from the last cell in the table above.",
        "Oracle Corporation",
    ),
    headings=("Document Control", "Change Record", "Reviewers", "Approvers", "Traceability Matrix", "Table of Contents"),
    prefixes=(
        "Client Name", "Release Name", "Project ID", "Document Ref", "Author", "Creation Date", "Last Updated", "Version", "Version number:", "Phone:", "Fax:",
    ),
    parts=(
        "Title, Subject, Last Updated Date, Reference Number, and Version are marked by a Word Bookmark",
        "Show bookmarks option in the Show document content region",
        "World Headquarters",
        "Worldwide Inquiries:",
        "www.oracle.com/ financial_services/",
        "Copyright ©",
        "No part of this work may be reproduced",
        "Oracle Financial Services Software Limited",
        "All company and product names are trademarks",
    ),
)


def is_heading(x: Column, rules: NoiseRules = DEFAULT_NOISE) -> Column:
    return x.isin(*rules.headings)


def is_toc_line(x: Column) -> Column:
    return strip(x).rlike(TOC_LINE)


def is_noise(x: Column, rules: NoiseRules = DEFAULT_NOISE) -> Column:
    """Whether a paragraph is blank or boilerplate."""
    return is_bare_noise(strip(x), rules)


def is_bare_noise(bare: Column, rules: NoiseRules = DEFAULT_NOISE) -> Column:
    """As ``is_noise``, of a paragraph that is stripped already; cheap tests come first."""
    tests = [bare == "", bare.isin(*rules.exact), is_heading(bare, rules)]
    tests += [bare.startswith(p) for p in rules.prefixes] + [bare.contains(p) for p in rules.parts] + [bare.rlike(TOC_LINE)]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out
