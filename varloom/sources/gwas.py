"""Association tables of many layouts, read as text and typed by name."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import autosomal, chrom_number, effective_n, finite_or, p_to_z, variant_id
from ..operators.liftover import lift
from ..session import Scratch
from .files import Files

#: Accepted names of each column, in the order in which they are looked for.
ALIASES = {
    "chrom": ["chrom", "chr", "chromosome", "#chrom", "hg19chrc"],
    "pos": ["pos", "bp", "position", "base_pair_location", "base_pair_position"],
    "variant_id": ["variant_id", "variantid"],
    "snp": ["snp", "rsid", "markerid", "rs_id", "snp_id", "id"],
    "z": ["z", "zscore", "z_score"],
    "beta": ["beta", "effect", "b"],
    "se": ["se", "standard_error", "stderr", "sebeta"],
    "p": ["p", "pval", "p_value", "pvalue", "p.value"],
    "n": ["n", "nsum", "neff", "samplesize", "n_complete_samples"],
}


def pick(columns: list[str], wanted: str) -> str | None:
    """The first alias of ``wanted`` among the columns, whatever their case."""
    have = {c.lower(): c for c in reversed(columns)}
    return next((have[a] for a in ALIASES[wanted] if a in have), None)


def read_delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """All columns as text. The separator follows the suffix (``.csv`` or tab, compressed or not) or, if asked, any white space."""
    name = path[: -len(".gz")] if path.endswith(".gz") else path
    sep = sep or ("," if name.endswith(".csv") else "\t")
    if sep != "whitespace":
        return spark.read.csv(path, sep=sep, header=True, inferSchema=False)
    lines = spark.read.text(path)
    names = lines.first()["value"].split()
    f = F.split(F.trim("value"), r"\s+")
    return lines.where(F.trim("value") != " ".join(names)).where(F.size(f) == len(names)).where(f[0] != names[0]).select(*[f[i].alias(n) for i, n in enumerate(names)])


def normalise(df: DataFrame) -> DataFrame:
    """``chrom, pos, variant_id, snp, z, chisq, n``; z from z, else beta/se, else p; rows without a finite chi-square are left out.

    Columns without a source are null; a table without any of z, beta with se, or p is an error.
    """
    at = {k: pick(df.columns, k) for k in ALIASES}
    num = lambda k: F.col(f"`{at[k]}`").cast("string").try_cast("double") if at[k] else F.lit(None).cast("double")
    if at["z"]:
        z = num("z")
    elif at["beta"] and at["se"]:
        z = F.try_divide(num("beta"), num("se"))
    elif at["p"]:
        z = p_to_z(num("p"))
    else:
        raise ValueError("no z, beta with se, or p column")
    chrom = chrom_number(f"`{at['chrom']}`") if at["chrom"] else F.lit(None).cast("int")
    pos = num("pos").cast("long")
    vid = F.col(f"`{at['variant_id']}`") if at["variant_id"] else variant_id(chrom, pos)
    out = df.select(chrom.alias("chrom"), pos.alias("pos"), vid.alias("variant_id"), (F.col(f"`{at['snp']}`") if at["snp"] else F.lit(None).cast("string")).alias("snp"), z.alias("z"), num("n").alias("n"))
    out = out.withColumn("z", finite_or(F.col("z"), None)).withColumn("chisq", F.col("z") * F.col("z"))
    return out.where(finite_or(F.col("chisq"), None).isNotNull()).select("chrom", "pos", "variant_id", "snp", "z", "chisq", "n")


def read_gwas(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    return normalise(read_delimited(spark, path, sep))


@dataclass(frozen=True)
class Layout:
    """Column names of one study's layout; ``odds_ratio`` columns are logged to effects."""

    chrom: str
    pos: str
    snp: str
    a1: str
    a2: str
    se: str
    p: str
    beta: str | None = None
    odds_ratio: str | None = None
    n: str | None = None
    n_half: str | None = None
    cases: str | None = None
    controls: str | None = None
    extra: dict = field(default_factory=dict)
    snp_else: str | None = None
    n_else: str | None = None
    log10p: str | None = None
    study_n: float | None = None


#: Column names of five published layouts.
LAYOUTS = {
    "pd": dict(chrom="chromosome", pos="base_pair_position", snp="SNP_ID", a1="effect_allele", a2="other_allele", beta="beta", se="standard_error"),
    "bipolar": dict(chrom="CHR", pos="BP", snp="SNP", a1="A1", a2="A2", odds_ratio="OR", se="SE", n_half="Neff_half"),
    "mdd": dict(chrom="CHR", pos="BP", snp="SNP", a1="A1", a2="A2", odds_ratio="OR", se="SE", n="Neff"),
    "als": dict(chrom="chromosome", pos="base_pair_location", snp="rsid", a1="effect_allele", a2="other_allele", beta="beta", se="standard_error", n="N_effective"),
    "anxiety": dict(chrom="CHR", pos="BP", snp="SNP", a1="A1", a2="A2", beta="BETA", se="SE"),
}
#: A summary-statistics exchange file, and a variant-call file's extracted fields (the alternative allele is the effect's).
LAYOUTS["exchange"] = dict(chrom="chromosome", pos="base_pair_location", snp="rs_id", snp_else="variant_id", a1="effect_allele", a2="other_allele", beta="beta", se="standard_error", n="Neff_total", extra={"n_cases": "N_cases", "n_controls": "N_controls"})
LAYOUTS["extracted"] = dict(chrom="CHROM", pos="POS", snp="ID", a1="ALT", a2="REF", beta="ES", se="SE", n="NE", n_else="NS", log10p="LP", extra={"n_total": "NS"})


def layout(name: str, study_n: float | None = None) -> Layout:
    """A layout by name; ``study_n`` is the sample size where a file has none of its own."""
    return Layout(p="", study_n=study_n, **LAYOUTS[name])


def apply_layout(df: DataFrame, s: Layout) -> DataFrame:
    """``chrom, pos, snp, a1, a2, beta, se, p, n``: one projection for every layout.

    ``n`` is the stated size, else a second one, else twice the half size, else 4ab/(a+b) of cases and
    controls, else the study's. Rows that are malformed, not autosomal, or without finite effect, positive error and size are left out.
    """
    num = lambda c: F.col(f"`{c}`").cast("string").try_cast("double") if c else F.lit(None).cast("double")
    beta: Column = num(s.beta) if s.beta else F.when(num(s.odds_ratio) > 0, F.ln(num(s.odds_ratio)))
    positive = lambda c: F.when(c > 0, c)
    n = F.coalesce(positive(num(s.n)) if s.n_else else num(s.n), num(s.n_else), 2 * num(s.n_half), effective_n(num(s.cases), num(s.controls)), F.lit(s.study_n).cast("double"))
    p = F.pow(F.lit(10.0), -num(s.log10p)) if s.log10p else num(s.p)
    snp = F.col(f"`{s.snp}`")
    if s.snp_else and s.snp_else in df.columns:
        snp = F.coalesce(F.when(snp != "", snp), F.col(f"`{s.snp_else}`"))
    if missing := {c for c in (s.chrom, s.pos, s.snp, s.a1, s.a2, s.se, s.beta, s.odds_ratio, s.n, s.n_half) if c} - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    out = df.select(
        chrom_number(f"`{s.chrom}`").alias("chrom"), num(s.pos).cast("long").alias("pos"), snp.alias("snp"),
        F.upper(f"`{s.a1}`").alias("a1"), F.upper(f"`{s.a2}`").alias("a2"), finite_or(beta, None).alias("beta"), finite_or(num(s.se), None).alias("se"), p.alias("p"), finite_or(n, None).alias("n"),
        *[num(c).alias(k) for k, c in s.extra.items()],
    )
    return out.where(autosomal("chrom") & (F.col("pos") > 0) & F.col("beta").isNotNull() & (F.col("se") > 0) & (F.col("n") > 0))


def read_top_associations(spark: SparkSession, glob: str, names: dict[str, str]) -> DataFrame:
    """Lead associations of many files; the context is looked up by the file name's code before ``_top_assoc``."""
    df = spark.read.csv(glob, sep="\t", header=True, inferSchema=False)
    code = F.regexp_extract(F.input_file_name(), r"([^/]+)_top_assoc\.tsv(?:\.gz)?$", 1)
    lookup = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    d = lambda c: F.col(f"`{c}`").try_cast("double")
    out = df.select(
        F.col("feature").alias("gene"), chrom_number("CHR").alias("chrom"), d("POS").cast("long").alias("pos"), F.col("MarkerID").alias("marker"),
        d("BETA").alias("beta"), d("SE").alias("se"), d("Tstat").alias("z"), d("p.value").alias("p"), lookup[code].alias("context"),
    )
    return out.where(autosomal("chrom") & F.col("pos").isNotNull() & F.col("context").isNotNull())


def prepare_study(df: DataFrame, s: Layout, out: str, blocks: DataFrame | None = None) -> dict:
    """One study's table, normalised, lifted through ``blocks`` where given, as gzip text ``CHR, BP, SNP, A1, A2, BETA, SE, N, ...``, with a manifest beside it.

    A coordinate that does not lift, or not to one place, leaves the table and is counted. No valid row is an error.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "study")
    x = scratch.stage(apply_layout(df, s))
    kept = x
    if blocks is not None:
        at = x.select("chrom", (F.col("pos") - 1).alias("_p")).distinct().withColumn("k", F.concat_ws(":", F.col("chrom").cast("string"), F.col("_p").cast("string")))
        to = at.join(lift(at, blocks, "k", pos="_p"), "k").select("chrom", (F.col("_p") + 1).alias("pos"), F.col("to_chrom").alias("_c"), (F.col("to_pos") + 1).alias("_to"))
        kept = scratch.stage(x.join(to, ["chrom", "pos"]).withColumns({"chrom": F.col("_c"), "pos": F.col("_to")}).select(*x.columns))
    extra = list(s.extra)
    rows = kept.select(F.col("chrom").alias("CHR"), F.col("pos").alias("BP"), F.col("snp").alias("SNP"), F.col("a1").alias("A1"), F.col("a2").alias("A2"), F.col("beta").alias("BETA"), F.col("se").alias("SE"), F.col("n").alias("N"), *[F.col(c).alias(c.upper()) for c in extra])
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.min("N").alias("lo"), F.max("N").alias("hi")).first()
    if not r["n"]:
        raise ValueError("no valid autosomal row")
    rows.write.mode("overwrite").option("header", True).option("sep", "\t").option("compression", "gzip").csv(f"{out}/table")
    valid = x.count()
    result = {"source_records": df.count(), "valid_records": valid, "output_records": r["n"], "unmapped_records": valid - r["n"], "n_min": r["lo"], "n_max": r["hi"], "sample_size_source": "study" if s.study_n and not (s.n or s.n_half) else "variant"}
    Files(out).write_json("manifest.json", result, sort_keys=True)
    scratch.close()
    return result
