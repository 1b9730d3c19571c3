"""Variant (VCF) rows: filters, classes, genotypes, long and wide forms."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.functions.cells import parse_number
from assayloom.functions.hts import ANN_FIELDS, CSQ_FIELDS, gt_alleles, gt_missing, info_values, sample_field
from assayloom.operators.once import compute_once
from assayloom.operators.ordering import sample_rows


def typed_variants(raw: DataFrame) -> DataFrame:
    """Text VCF columns to typed ones: ``end`` added, ``.`` read as missing for ID and QUAL."""
    dot = lambda c: F.when((F.col(c) != ".") & (F.col(c) != ""), F.col(c))
    rest = [c for c in raw.columns if c not in ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info")]
    return raw.select(
        "chrom", F.col("pos").cast("string").try_cast("bigint").alias("pos"),
        (F.col("pos").cast("string").try_cast("bigint") + F.length("ref") - 1).alias("end"), dot("id").alias("id"), "ref", "alt",
        parse_number(F.col("qual").cast("string")).alias("qual"), "filter", "info", *rest,
    ).filter(F.col("pos").isNotNull())


def variant_type(ref: Column, alt: Column) -> Column:
    alleles = F.filter(F.split(alt, ","), lambda a: a != "")
    first = F.coalesce(F.try_element_at(alleles, F.lit(1)), F.lit(""))
    return (
        F.when(F.size(alleles) > 1, "multiallelic")
        .when(first.startswith("<") | first.contains("[") | first.contains("]"), "symbolic")
        .when((F.length(ref) == 1) & (F.length(first) == 1), "snv")
        .when((F.length(ref) > 1) & (F.length(first) == F.length(ref)), "mnv")
        .when(F.length(first) > F.length(ref), "insertion")
        .when(F.length(first) < F.length(ref), "deletion")
        .otherwise("indel")
    )


def _type_matches(wanted: str) -> Column:
    kind = variant_type(F.col("ref"), F.col("alt"))
    return kind.isin("insertion", "deletion", "indel") if wanted == "indel" else kind == wanted


def filter_sites(
    variants: DataFrame, *, chromosome: str | None = None, region_start: int | None = None, region_end: int | None = None,
    filter_status: str = "any", filter_names: Sequence[str] = (), min_qual: float | None = None, variant: str = "any", id_mode: str = "any",
) -> DataFrame:
    out = variants
    if chromosome:
        out = out.filter(F.col("chrom") == chromosome)
    if region_start is not None:
        out = out.filter(F.col("end") >= region_start)
    if region_end is not None:
        out = out.filter(F.col("pos") <= region_end)
    status = F.when(F.coalesce(F.col("filter"), F.lit("")) == "", ".").otherwise(F.col("filter"))
    passes = status.isin("PASS", ".")
    if filter_status == "pass":
        out = out.filter(passes)
    elif filter_status == "non-pass":
        out = out.filter(~passes)
    elif filter_status == "named":
        out = out.filter(F.arrays_overlap(F.split(status, ";"), F.array(*[F.lit(n) for n in filter_names])))
    if min_qual is not None:
        out = out.filter(F.col("qual") >= min_qual)
    if variant != "any":
        out = out.filter(_type_matches(variant))
    if id_mode != "any":
        has = F.col("id").isNotNull()
        out = out.filter(has if id_mode == "has-id" else ~has)
    return out


def info_condition(info: Column, expression: str) -> Column:
    """``KEY op value``: true when any value of the key fits; numeric when both sides are numbers."""
    found = re.match(r"^([A-Za-z0-9_.-]+)\s*(<=|>=|!=|==|=|<|>)\s*(.+)$", expression.strip())
    if not found:
        raise ValueError(f"not an INFO condition: {expression!r}")
    key, operator, wanted = found[1], found[2].replace("==", "="), found[3].strip().strip('"')
    try:
        limit = float(wanted)
    except ValueError:
        limit = None
    same_text = lambda v: v == wanted if operator == "=" else v != wanted if operator == "!=" else F.lit(False)

    def fits(v: Column) -> Column:
        if limit is None:
            flag = (v == "true") & F.lit(operator == "=" and wanted.lower() == "true")
            return flag | same_text(v)
        n = parse_number(v)
        tests = {"<": n < limit, "<=": n <= limit, ">": n > limit, ">=": n >= limit, "=": n == limit, "!=": n != limit}
        flag = (v == "true") & F.lit(operator == "=" and limit == 1)
        return F.coalesce(tests[operator], same_text(v)) | flag

    return F.coalesce(F.exists(info_values(info, key), fits), F.lit(False))


def filter_info(variants: DataFrame, expressions: Sequence[str]) -> DataFrame:
    for expression in expressions:
        variants = variants.filter(info_condition(F.col("info"), expression))
    return variants


def filter_consequence(
    variants: DataFrame, *, field: str = "auto", impact: str | None = None, terms: Sequence[str] = (), genes: Sequence[str] = (),
    transcripts: Sequence[str] = (), amino_acids: Sequence[str] = (), formats: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Keep variants with one annotation that meets every given rule; its summary goes to ``consequence``."""
    orders = {"ANN": ANN_FIELDS, "CSQ": CSQ_FIELDS, **(formats or {})}
    summaries = []
    for name in ["ANN", "CSQ"] if field == "auto" else [field]:
        order = orders[name]

        def part(parts: Column, *names: str, order=order) -> Column:
            options = [F.try_element_at(parts, F.lit(order.index(n) + 1)) for n in names if n in order]
            filled = [F.when(o != "", o) for o in options]
            return F.coalesce(*filled, F.lit("")) if filled else F.lit("")

        def meets(entry: Column) -> Column:
            p = F.split(entry, r"\|")
            rules = [F.lit(True)]
            if impact:
                rules.append(F.upper(part(p, "Annotation_Impact", "IMPACT")) == impact.upper())
            if terms:
                found = F.transform(F.split(F.lower(part(p, "Annotation", "Consequence")), "[&,+]"), F.trim)
                rules.append(F.arrays_overlap(found, F.array(*[F.lit(x.lower()) for x in terms])))
            if genes:
                wanted = [g.lower() for g in genes]
                rules.append(F.lower(part(p, "Gene_Name", "SYMBOL")).isin(wanted) | F.lower(part(p, "Gene_ID", "Gene")).isin(wanted))
            if transcripts:
                rules.append(F.lower(part(p, "Feature_ID", "Feature")).isin([x.lower() for x in transcripts]))
            if amino_acids:
                texts = [F.lower(part(p, "HGVS.p", "HGVSp")), F.lower(part(p, "Amino_acids"))]
                rules.append(reduce(lambda a, b: a | b, [x.contains(c.lower()) for x in texts for c in amino_acids]))
            return reduce(lambda a, b: a & b, rules)

        def summary(entry: Column) -> Column:
            p = F.split(entry, r"\|")
            cells = [part(p, "Annotation", "Consequence"), F.upper(part(p, "Annotation_Impact", "IMPACT")), part(p, "Gene_Name", "SYMBOL"),
                     part(p, "Feature_ID", "Feature"), part(p, "HGVS.p", "HGVSp")]
            return F.array_join(F.filter(F.array(*cells), lambda c: c != ""), "|")

        summaries.append(F.try_element_at(F.transform(F.filter(info_values(F.col("info"), name), meets), summary), F.lit(1)))
    return compute_once(variants, consequence=F.coalesce(*summaries)).filter(F.col("consequence").isNotNull())


def sample_structs(samples: Sequence[str]) -> Column:
    """``(sample, gt, dp, gq, ad)`` per sample column."""
    names = F.array(*[F.lit(s) for s in samples])
    field = lambda v, key: sample_field(F.col("format"), v, key)
    return F.transform(
        F.col("sample_values"),
        lambda v, i: F.struct(
            F.coalesce(F.try_element_at(names, i + 1), F.concat(F.lit("sample_"), (i + 1).cast("string"))).alias("sample"),
            F.coalesce(field(v, "GT"), F.lit("")).alias("gt"), field(v, "DP").try_cast("double").alias("dp"),
            field(v, "GQ").try_cast("double").alias("gq"), field(v, "AD").alias("ad"),
        ),
    )


def _picked(samples: Sequence[str], names: Sequence[str]) -> Column:
    all_samples = sample_structs(samples)
    return F.filter(all_samples, lambda s: s["sample"].isin(list(names))) if names else all_samples


def missing_rate(chosen: Column) -> Column:
    total = F.size(chosen)
    return F.when(total > 0, F.size(F.filter(chosen, lambda s: gt_missing(s["gt"]))) / total)


def filter_genotypes(
    variants: DataFrame, samples: Sequence[str], *, genotype: str = "any", site: str = "any", max_missing_rate: float | None = None,
    min_depth: float | None = None, min_gq: float | None = None, sample_names: Sequence[str] = (),
) -> DataFrame:
    """Site rules over the chosen samples, then at least one sample that meets the sample rules."""
    rows = compute_once(variants, __s=_picked(samples, sample_names)).withColumn("__rate", missing_rate(F.col("__s")))
    rows = rows.filter((F.size("__s") > 0) & _site_rule(F.col("__s"), site))
    if max_missing_rate is not None:
        rows = rows.filter(F.col("__rate") <= max_missing_rate)
    meets = lambda s: _sample_rule(s, genotype, min_depth, min_gq)
    named = compute_once(rows, __n=F.transform(F.filter("__s", meets), lambda s: s["sample"])).filter(F.size("__n") > 0)
    return named.withColumn("matching_samples", F.array_join("__n", ",")).withColumn(
        "missing_genotype_rate", F.round("__rate", 4)
    ).drop("__s", "__rate", "__n")


def _site_rule(chosen: Column, site: str) -> Column:
    reference = lambda s: ~gt_missing(s["gt"]) & F.forall(gt_alleles(s["gt"]), lambda a: a == "0")
    return {
        "any": F.lit(True),
        "all-called": F.forall(chosen, lambda s: ~gt_missing(s["gt"])),
        "any-missing": F.exists(chosen, lambda s: gt_missing(s["gt"])),
        "all-hom-ref": F.forall(chosen, lambda s: reference(s) & (F.size(gt_alleles(s["gt"])) >= 2)),
        "all-reference": F.forall(chosen, reference),
    }[site]


def _sample_rule(s: Column, genotype: str, min_depth: float | None, min_gq: float | None) -> Column:
    distinct = F.array_distinct(gt_alleles(s["gt"]))
    has_alt = F.exists(gt_alleles(s["gt"]), lambda a: a != "0")
    modes = {
        "any": F.lit(True), "missing": gt_missing(s["gt"]), "called": ~gt_missing(s["gt"]), "variant": has_alt,
        "heterozygous": has_alt & (F.size(distinct) > 1), "homozygous-alt": has_alt & (F.size(distinct) == 1),
    }
    rule = modes[genotype]
    if min_depth is not None:
        rule = rule & F.coalesce(s["dp"] >= min_depth, F.lit(False))
    if min_gq is not None:
        rule = rule & F.coalesce(s["gq"] >= min_gq, F.lit(False))
    return rule


def genotype_census(variants: DataFrame, samples: Sequence[str], rules: dict[str, dict]) -> DataFrame:
    """``(mode, sites)``: how many sites ``filter_genotypes`` keeps by each named set of its rules, in one pass."""
    rows = compute_once(variants.select("format", "sample_values"), __s=sample_structs(samples)).select("__s")

    def kept(
        *, genotype: str = "any", site: str = "any", max_missing_rate: float | None = None, min_depth: float | None = None,
        min_gq: float | None = None, sample_names: Sequence[str] = (),
    ) -> Column:
        chosen = F.filter("__s", lambda s: s["sample"].isin(list(sample_names))) if sample_names else F.col("__s")
        rule = (F.size(chosen) > 0) & _site_rule(chosen, site) & F.exists(chosen, lambda s: _sample_rule(s, genotype, min_depth, min_gq))
        return rule if max_missing_rate is None else rule & (missing_rate(chosen) <= max_missing_rate)

    counts = rows.agg(*[F.count(F.when(kept(**rule), 1)).alias(f"n{i}") for i, rule in enumerate(rules.values())])
    modes = F.array(*[F.struct(F.lit(name).alias("mode"), F.col(f"n{i}").alias("sites")) for i, name in enumerate(rules)])
    return counts.select(F.explode(modes).alias("m")).select("m.*")


def project_samples(variants: DataFrame, samples: Sequence[str], names: Sequence[str], *, keep: bool = True) -> tuple[DataFrame, list[str], list[str]]:
    """Keep or remove sample columns, order preserved: ``(variants, sample names left, names not in the header)``."""
    places = [i for i, s in enumerate(samples) if (s in names) == keep]
    values = F.array(*[F.try_element_at("sample_values", F.lit(i + 1)) for i in places]) if places else F.array().cast("array<string>")
    return variants.withColumn("sample_values", values), [samples[i] for i in places], [n for n in names if n not in samples]


def melt_genotypes(variants: DataFrame, samples: Sequence[str], sample_names: Sequence[str] = ()) -> DataFrame:
    """One row per variant and sample."""
    names = F.array(*[F.lit(s) for s in samples])
    keys = F.split("format", ":")
    cleaned = lambda v: F.array_join(
        F.transform(keys, lambda k, i: F.when((k != "GT") & (F.try_element_at(F.split(v, ":"), i + 1) == "."), "").otherwise(
            F.coalesce(F.try_element_at(F.split(v, ":"), i + 1), F.lit("")))), ":"
    )
    long = variants.select("chrom", "pos", "id", "ref", "alt", "format", F.posexplode("sample_values").alias("i", "v")).withColumn(
        "sample", F.coalesce(F.try_element_at(names, F.col("i") + 1), F.concat(F.lit("sample_"), (F.col("i") + 1).cast("string")))
    )
    if sample_names:
        long = long.filter(F.col("sample").isin(list(sample_names)))
    value = lambda key: F.when(sample_field(F.col("format"), F.col("v"), key) != ".", sample_field(F.col("format"), F.col("v"), key))
    return long.select(
        "chrom", "pos", "id", "ref", "alt", "sample", sample_field(F.col("format"), F.col("v"), "GT").alias("gt"), value("GQ").alias("gq"),
        value("DP").alias("dp"), value("AD").alias("ad"), "format", cleaned(F.col("v")).alias("sample_values"),
    )


def info_tags(variants: DataFrame) -> list[str]:
    """Tags in use; one short row each."""
    tags = variants.select(F.explode(F.split("info", ";")).alias("e")).select(F.substring_index("e", "=", 1).alias("tag"))
    return [r["tag"] for r in tags.filter(~F.col("tag").isin("", ".")).distinct().orderBy("tag").collect()]


def split_info(variants: DataFrame, header_tags: Sequence[str] = (), tags: Sequence[str] | None = None) -> DataFrame:
    """INFO tags as columns ``info_TAG``: header order first, then the other tags in use."""
    found = list(tags) if tags is not None else info_tags(variants)
    order = [*header_tags, *[x for x in found if x not in header_tags]]
    used: set[str] = set()
    columns = []
    for tag in order:
        base = "info_" + (re.sub(r"[^A-Za-z0-9_]+", "_", tag).strip("_") or "field")
        name, n = base, 2
        while name in used:
            name, n = f"{base}_{n}", n + 1
        used.add(name)
        text = F.array_join(info_values(F.col("info"), tag), ",")
        columns.append(F.when(text != ".", text).alias(name))
    return variants.select(*[c for c in variants.columns if c != "info"], *columns)


def header_tables(lines: DataFrame) -> DataFrame:
    """``##`` lines as rows: kind (INFO, FORMAT, FILTER, contig or metadata) and its fields."""
    text = F.col("line")
    kind = F.regexp_extract(text, r"^##(INFO|FORMAT|FILTER|contig)=<", 1)
    field = lambda key: F.nullif(F.regexp_extract(text, rf"[<,]{key}=([^,>\"]+)", 1), F.lit(""))
    quoted = F.nullif(F.regexp_extract(text, r'Description="((?:[^"\\]|\\.)*)"', 1), F.lit(""))
    return lines.filter(text.startswith("##")).select(
        F.when(kind == "", "metadata").otherwise(kind).alias("kind"),
        F.when(kind == "", F.regexp_extract(text, r"^##([^=]+)=", 1)).otherwise(field("ID")).alias("id"),
        field("Number").alias("number"), field("Type").alias("type"), F.replace(quoted, F.lit('\\"'), F.lit('"')).alias("description"),
        field("length").try_cast("bigint").alias("length"), F.when(kind == "", F.regexp_extract(text, r"^##[^=]+=(.*)$", 1)).alias("value"),
    )


def header_samples(lines: DataFrame) -> list[str]:
    """Sample names of the ``#CHROM`` lines, which must agree where there are several files."""
    heads = lines.filter(F.col("line").startswith("#CHROM")).select("line").distinct().limit(2).collect()
    if len(heads) > 1:
        raise ValueError("the files name different samples; read them one by one")
    return heads[0]["line"].split("\t")[9:] if heads else []


def sampling_candidates(
    variants: DataFrame, samples: Sequence[str], *, autosomes_only: bool = False, biallelic_only: bool = False, variant: str = "any",
    max_missing_rate: float | None = None,
) -> DataFrame:
    out = variants
    if autosomes_only:
        number = F.regexp_replace("chrom", "^(?i)chr", "")
        out = out.filter(number.rlike("^[1-9][0-9]?$") & (number.try_cast("int") <= 22))
    if biallelic_only:
        alleles = F.filter(F.split("alt", ","), lambda a: a != "")
        out = out.filter((F.size(alleles) == 1) & (F.col("alt") != "."))
    if variant != "any":
        out = out.filter(_type_matches(variant))
    if max_missing_rate is not None:
        out = out.filter(missing_rate(sample_structs(samples)) <= max_missing_rate)
    return out


def sample_variants(variants: DataFrame, samples: Sequence[str], n: int, seed: int, key: Sequence[str], **filters) -> DataFrame:
    return sample_rows(sampling_candidates(variants, samples, **filters), n, seed, key)
