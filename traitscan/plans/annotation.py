"""An annotation run from its sectioned configuration: lookups, computed columns, order and header.

    [GeneAnnot]
    file = genes.csv
    file_format = csv
    columns_kept = probe, seqname, symbol
    columns_rename = Probe, Gene_Chr, Gene
    Gene_Chr = substring(Gene_Chr, 4)

    [Main]
    input = pairs.csv
    output = annotated
    matching_rule = GeneAnnot.Probe == Main.ProbesetID
    Strong = if(cast(Main.RSq as double) > 0.5, 'y', 'n')
    column_order = ProbesetID, Gene, Gene_Chr, Strong, RSq
    new_header = Probe, Gene, Chr, Strong, RSq

Each section that a matching rule links is read, its columns are chosen, renamed
and changed by its own rules, and the last row of each key stays. Main's rows look
them up (a miss gives NULL), every lookup as a left join that is a broadcast only if
the section is small. Names are those of Catalyst: Section.column, or the column
alone where one section has it; an ambiguous or unknown name is an error. Rules
are Spark SQL over what was looked up; they do not see each other's results, and a
rule named as a column stands in its place. Without an order the sections' columns
come first, in the order of Main's columns that look them up, then Main's, then the
computed ones. Formats: csv, tab, space, a character in quotes, or parquet; columns
of text files are text. Paths are relative to the configuration's folder.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitscan.operators.annotate import last_per_key, lookup_side
from traitscan.sources.readers import read_ini

MAIN = "Main"
# The keys of the configuration file and the names of its formats.
SECTION_KEYS = ["file", "file_format", "columns_kept", "columns_rename"]
MAIN_KEYS = ["input", "output", "file_format", "matching_rule", "column_order", "new_header"]
SEPARATORS = {"csv": ",", "tab": "\t", "space": " "}

_REFERENCE = re.compile(r"[A-Za-z_][0-9A-Za-z_]*\..+")


@dataclass
class Section:
    """One annotation table and the main column that looks it up by the section's key."""

    name: str
    file: str
    format: str
    key: str
    column: str
    kept: list[str] = field(default_factory=list)
    renamed: list[str] = field(default_factory=list)
    rules: dict[str, str] = field(default_factory=dict)


@dataclass
class AnnotationPlan:
    input: str
    output: str
    format: str
    sections: list[Section]
    rules: dict[str, str] = field(default_factory=dict)
    order: list[str] = field(default_factory=list)
    header: list[str] = field(default_factory=list)


def _names(text: str | None) -> list[str]:
    return [x.strip() for x in text.split(",")] if text else []


def _split_reference(text: str) -> tuple[str, str]:
    text = text.strip()
    if not _REFERENCE.fullmatch(text):
        raise ValueError(f"{text!r} in a matching rule is no Section.column")
    section, _, column = text.partition(".")
    return section, column.strip()


def parse_plan(text: str) -> AnnotationPlan:
    """The plan of a configuration file; everything that can be wrong without the tables is an error here."""
    ini = read_ini(text, sections=True)
    if MAIN not in ini:
        raise ValueError("no section Main")
    main = ini[MAIN]
    for key in ("input", "output", "matching_rule"):
        if key not in main:
            raise ValueError(f"no {key} in Main")
    links: dict[str, tuple[str, str]] = {}
    for rule in filter(None, _names(main["matching_rule"])):
        left, eq, right = rule.partition("==")
        if not eq:
            raise ValueError(f"no == in the matching rule {rule!r}")
        sides = [_split_reference(left), _split_reference(right)]
        for name, _ in sides:
            if name not in ini:
                raise ValueError(f"the matching rule {rule!r} names an unknown section")
        if [name for name, _ in sides].count(MAIN) != 1:
            raise ValueError(f"the matching rule {rule!r} does not link Main with a section")
        (_, column), (name, key) = sides if sides[0][0] == MAIN else sides[::-1]
        if name in links:
            raise ValueError(f"section {name} is linked twice")
        links[name] = (key, column)
    if not links:
        raise ValueError("the matching rule is blank")
    sections = []
    for name, (key, column) in links.items():
        given = ini[name]
        if "file" not in given:
            raise ValueError(f"no file in section {name}")
        kept, renamed = _names(given.get("columns_kept")), _names(given.get("columns_rename"))
        if renamed and len(renamed) != len(kept):
            raise ValueError(f"section {name} keeps {len(kept)} columns and renames {len(renamed)}")
        sections.append(Section(name, given["file"], given.get("file_format", "csv"), key, column, kept, renamed, {k: v for k, v in given.items() if k not in SECTION_KEYS}))
    order, header = _names(main.get("column_order")), _names(main.get("new_header"))
    if order and header and len(order) != len(header):
        raise ValueError(f"column_order has {len(order)} names and new_header {len(header)}")
    return AnnotationPlan(main["input"], main["output"], main.get("file_format", "csv"), sections, {k: v for k, v in main.items() if k not in MAIN_KEYS}, order, header)


def read_section_file(spark: SparkSession, path: str, format_: str) -> DataFrame:
    """A table by its format; text rows of another width than the header's are an error."""
    kind = format_.strip()
    if kind.lower() == "parquet":
        return spark.read.parquet(path)
    if len(kind) > 2 and kind[0] == kind[-1] == '"':
        sep = kind[1:-1]
    else:
        sep = SEPARATORS.get(kind.lower(), kind)
    return spark.read.options(header=True, sep=sep, mode="FAILFAST", columnPruning=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(path)


def section_table(df: DataFrame, section: Section) -> DataFrame:
    """The section's columns after choice, names and rules, one row per key: the last in the file."""
    kept = section.kept or list(df.columns)
    names = section.renamed or kept
    if twice := [n for n, k in Counter(names).items() if k > 1]:
        raise ValueError(f"section {section.name} has column {twice[0]} twice")
    if section.key not in names:
        if section.key not in df.columns:
            raise ValueError(f"section {section.name} has no key column {section.key}")
        kept, names = [section.key, *kept], [section.key, *names]
    missing = [c for c in kept if c not in df.columns]
    if missing:
        raise ValueError(f"{section.file} has no column {missing[0]}")
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    out = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)), place.alias("_place"))
    rules = {k.removeprefix(f"{section.name}."): v for k, v in section.rules.items()}
    if rules:
        plain = [F.expr(rules[n]).alias(n) if n in rules else F.col(f"`{n}`") for n in names]
        out = out.alias(section.name).select(*plain, *(F.expr(r).alias(n) for n, r in rules.items() if n not in names), "_place")
    return last_per_key(out, section.key, ["_place"]).select(*(c for c in out.columns if c != "_place"))


def annotated(plan: AnnotationPlan, read: Callable[[str, str], DataFrame]) -> DataFrame:
    """The annotated rows of Main; read(file, format) gives a table."""
    main = read(plan.input, plan.format)
    for s in plan.sections:
        if s.column not in main.columns:
            raise ValueError(f"Main has no column {s.column}")
    linked = sorted(plan.sections, key=lambda s: main.columns.index(s.column))
    out, columns = main.alias(MAIN), []
    for s in linked:
        side = section_table(read(s.file, s.format), s)
        columns += [(s.name, c) for c in side.columns]
        out = out.join(lookup_side(side).alias(s.name), F.col(f"{MAIN}.`{s.column}`") == F.col(f"{s.name}.`{s.key}`"), "left")
    columns += [(MAIN, c) for c in main.columns]
    owners: dict[str, list[str]] = {}
    for s, c in columns:
        owners.setdefault(c, []).append(s)
    known = {f"{s}.{c}": (s, c) for s, c in columns}
    if len(known) < len(columns):
        raise ValueError("two columns have one qualified name")

    def resolve(name: str) -> tuple[str, str] | None:
        if name in known:
            return known[name]
        found = owners.get(name, [])
        if len(found) > 1:
            raise ValueError(f"column {name} is in {' and '.join(found)}: write Section.{name}")
        return (found[0], name) if found else None

    rules = {(resolve(name) or name): rule for name, rule in plan.rules.items()}
    if len(rules) < len(plan.rules):
        raise ValueError("a column has two rules")
    wanted: Sequence[tuple[str, str] | str]
    if plan.order:
        wanted = [resolve(name) or name for name in plan.order]
        unknown = [x for x in wanted if isinstance(x, str) and x not in rules]
        if unknown:
            raise ValueError(f"column {unknown[0]} is not found")
        names = plan.order
    else:
        wanted = [*columns, *(x for x in rules if isinstance(x, str))]
        names = [x if isinstance(x, str) else ".".join(x) for x in wanted]
    names = plan.header or names
    if len(names) != len(wanted):
        raise ValueError(f"new_header has {len(names)} names for {len(wanted)} columns")
    if twice := [n for n, k in Counter(n.lower() for n in names).items() if k > 1]:
        raise ValueError(f"the result would have column {twice[0]} twice")
    cell = lambda x: F.expr(rules[x]) if x in rules else F.col(f"{x[0]}.`{x[1]}`")
    return out.select(*(cell(x).alias(n) for x, n in zip(wanted, names, strict=True)))


def run_annotation(spark: SparkSession, path: str) -> DataFrame:
    """Read a configuration, write its output as CSV with a header, and return the rows."""
    plan = parse_plan(spark.read.text(path, wholetext=True).first()[0])
    folder = path.rsplit("/", 1)[0] if "/" in path else "."
    whole = lambda p: p if p.startswith("/") or "://" in p else f"{folder}/{p}"
    out = annotated(plan, lambda file, format_: read_section_file(spark, whole(file), format_))
    out.write.csv(whole(plan.output), header=True, mode="errorifexists", nullValue="")
    return out
