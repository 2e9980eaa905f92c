"""An association analysis from its configuration: read, validate, scan, write."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import PurePosixPath

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitscan.functions.arrays import permuted
from traitscan.operators import assoc
from traitscan.operators.profile import recode_additive
from traitscan.sources import readers
from traitscan.sources.writers import write_pairs
from traitscan.tables import written


class ConfigError(ValueError):
    """Something in the configuration or its files does not fit."""


@dataclass
class AnalysisConfig:
    genotype_file: str = ""
    expression_file: str = ""
    covariate_file: str = ""
    family_file: str = ""
    pedigree_file: str = ""
    output_file: str = ""
    genotype_format: str = "tped"
    genotype_file_header: bool = True
    simplify_output: bool = False
    rsq_only: bool = False
    pval_only: bool = False
    genotype_model: str = "additive"
    covariate_fixed: tuple[str, ...] = ()
    covariate_factor: tuple[str, ...] = ()
    covariate_random: tuple[str, ...] = ()
    threshold: tuple[str, float] | None = None
    df_offset: int = 0

    @classmethod
    def from_ini(cls, text: str, folder: str = "") -> AnalysisConfig:
        """From key=value lines; relative paths resolve against the folder; other keys are ignored."""
        ini, got = readers.read_ini(text), {}
        for f in fields(cls):
            if f.name not in ini:
                continue
            v = ini[f.name]
            if f.name.endswith("_file"):
                got[f.name] = str(PurePosixPath(folder) / v) if folder and "://" not in v else v
            elif isinstance(f.default, bool):
                got[f.name] = v.lower() in ("true", "yes", "1")
            elif f.name == "df_offset":
                got[f.name] = int(v)
            elif f.name.startswith("covariate_"):
                got[f.name] = tuple(v.split())
            elif f.name == "threshold":
                kind, *bound = v.lower().split()
                if kind not in ("none", "rsq", "pval") or (kind != "none" and not bound):
                    raise ConfigError(f"threshold {v!r}")
                got[f.name] = None if kind == "none" else (kind, float(bound[0]))
            else:
                got[f.name] = v
        return cls(**got)


def covariate_design(cov: DataFrame, fixed: tuple[str, ...], factors: tuple[str, ...]) -> np.ndarray:
    """The design of a table of samples; a*b in fixed is an interaction."""
    names = {part for term in (*fixed, *factors) for part in term.split("*")}
    unknown = names - set(cov.columns)
    if unknown:
        raise ConfigError(f"unknown covariates: {', '.join(sorted(unknown))}")
    rows = cov.select(*sorted(names)).toPandas()  # one row per sample
    plain = [t for t in fixed if "*" not in t]
    crossed = [tuple(t.split("*")) for t in fixed if "*" in t]
    categorical = {c for c, t in cov.select(*sorted(names)).dtypes if t == "string"}
    factor = [*dict.fromkeys([*factors, *(t for t in plain if t in categorical), *(p for ab in crossed for p in ab if p in categorical)])]
    number = [*dict.fromkeys([*(t for t in plain if t not in factor), *(p for ab in crossed for p in ab if p not in factor)])]
    return assoc.design_matrix(len(rows), {c: rows[c].tolist() for c in number}, {c: rows[c].tolist() for c in factor}, crossed)


def by_subject(subjects: list[str], names: list[str]) -> list[int]:
    """The places in names of the family file's subjects; none where they do not name the same samples, which are then matched by place."""
    if len(set(names)) != len(names) or set(names) != set(subjects):
        return []
    place = {name: k for k, name in enumerate(names)}
    return [place[s] for s in subjects]


def tped_values(tped: DataFrame, samples: int | None) -> DataFrame:
    """(id, values): dosages as they are; two allele letters a sample as 0, 1, 2 minor alleles."""
    letters = F.size("tokens") == 2 * F.lit(samples or 0)
    dosages = readers.tped_dosages(tped.where(~letters)).select("id", "values")
    coded = recode_additive(readers.tped_symbols(tped.where(letters))).select("id", F.col("codes").cast("array<double>").alias("values"))
    # written, as filters on codes would otherwise repeat the whole recoding inside each other
    return dosages.unionByName(written(coded, "codes"))


def run_analysis(spark: SparkSession, cfg: AnalysisConfig) -> DataFrame:
    """The pair table in the layout asked for; written to output_file if there is one.

    Genotypes are in the order of the family file. Where the expression file's
    header, or the first column of the covariates, names its subjects, these are
    matched by name, else by place.
    """
    if cfg.genotype_model != "additive":
        raise ConfigError(f"genotype model {cfg.genotype_model!r} is not supported")
    for name in ("genotype_file", "expression_file"):
        if not getattr(cfg, name):
            raise ConfigError(f"{name} is missing")
    for name in ("pedigree_file", "covariate_random"):
        if getattr(cfg, name):
            raise ConfigError(f"{name} is not supported")
    y = readers.matrix_table(spark, cfg.expression_file)
    samples = y.agg(F.max(F.size("values"))).first()[0]
    if cfg.genotype_format == "tped":
        x = tped_values(readers.read_tped(spark, cfg.genotype_file), samples)
    else:
        x = readers.matrix_table(spark, cfg.genotype_file, cfg.genotype_file_header)
    subjects: list[str] = []
    if cfg.family_file:
        subjects = readers.subject_order(spark, cfg.family_file)
        if len(subjects) != samples:
            raise ConfigError(f"{len(subjects)} subjects in {cfg.family_file} for {samples} samples")
        order = by_subject(subjects, readers.sample_names(spark, cfg.expression_file))
        if order:
            y = y.withColumn("values", permuted("values", F.array(*map(F.lit, order))))
    sizes = [df.agg(F.min(F.size("values")), F.max(F.size("values"))).first() for df in (x, y)]
    if len({v for s in sizes for v in s}) != 1 or sizes[0][0] is None:
        raise ConfigError(f"samples differ: genotypes {tuple(sizes[0])}, expressions {tuple(sizes[1])}")
    n, design = sizes[0][0], None
    if cfg.covariate_file:
        covariates = readers.covariate_table(spark, cfg.covariate_file)
        design = covariate_design(covariates, cfg.covariate_fixed, cfg.covariate_factor)
        order = by_subject(subjects, [str(r[0]) for r in covariates.select(F.col(f"`{covariates.columns[0]}`")).collect()])  # one row per sample
        design = design[order] if order else design
        if len(design) != n:
            raise ConfigError(f"{len(design)} rows of covariates for {n} samples")
    pairs = assoc.association(x, y, n, design, cfg.threshold, cfg.df_offset)
    layout = "rsq_only" if cfg.rsq_only else "pval_only" if cfg.pval_only else "full"
    out = assoc.pair_layout(pairs, layout, cfg.simplify_output)
    if cfg.output_file:
        write_pairs(out, cfg.output_file)
    return out
