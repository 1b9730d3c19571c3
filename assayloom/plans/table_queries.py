"""Queries for the table operators: cleaning, joins, aggregates, ordering, reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.operators import aggregates as ag
from assayloom.operators import cleaning as cl
from assayloom.operators import joins as jo
from assayloom.operators import ordering as od
from assayloom.operators import reshape as rs
from assayloom.operators import text as tx
from assayloom.operators.ladder import average_ranks, numbered
from assayloom.plans import fixtures as fx
from assayloom.plans.registry import Tables, query
from assayloom.session import shared_folder
from assayloom.sources import sequences as se

NUM = r"'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'"
NATURAL = (
    "list_transform(regexp_extract_all({0}, '(\\d+|\\D+)'), lambda x: CASE WHEN regexp_matches(x, '^\\d') THEN "
    "lpad(cast(length(regexp_replace(x, '^0+(\\d)', '\\1')) as varchar), 6, '0') || regexp_replace(x, '^0+(\\d)', '\\1') ELSE lower(x) END)"
)


@query(
    "T1_clean_cells",
    f"""WITH {fx.MESSY}, c AS (SELECT sample_id, regexp_replace(regexp_replace(name, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS name2,
      name, segment, CASE WHEN lower(trim(segment)) IN ('na', 'n/a') THEN '' ELSE trim(segment) END AS segment2, balance, notes FROM messy)
    SELECT sample_id, name2 AS name, segment2 AS segment, balance, notes,
      cast(name2 <> name as bigint) + cast(segment2 <> segment as bigint) AS changed_cells FROM c""",
)
def _t1(t: Tables) -> DataFrame:
    return cl.clean_cells(fx.messy_customers(t), missing_values=["NA", "n/a"], count_column="changed_cells")


@query(
    "T2_filter_rows",
    f"""WITH {fx.MESSY} SELECT * FROM messy WHERE contains(lower(name), 'cust') AND NOT contains(lower(segment), 'house')
      AND trim(segment) <> '' AND regexp_matches(trim(balance), {NUM}) AND try_cast(balance as double) > 1000
      AND try_cast(balance as double) <= 9000 AND segment <> 'NA'""",
)
def _t2(t: Tables) -> DataFrame:
    rules = [("name", "contains", "CUST"), ("segment", "not_contains", "house"), ("segment", "not_empty"),
             ("balance", "gt", "1000"), ("balance", "lte", 9000), ("segment", "not_equals", "NA")]
    return cl.filter_rows(fx.messy_customers(t), rules)


@query("T3_select_columns", "SELECT o_totalprice, o_orderkey FROM orders")
def _t3(t: Tables) -> DataFrame:
    return cl.select_columns(t.orders, ["O_TOTALPRICE", "o_orderkey"])


@query("T3_drop_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _t3b(t: Tables) -> DataFrame:
    return cl.drop_columns(t.orders, ["o_orderstatus", "o_orderdate", "o_orderpriority"])


@query("T4_filter_columns", "SELECT o_orderkey, o_custkey FROM orders")
def _t4(t: Tables) -> DataFrame:
    return cl.filter_columns(t.orders, [("starts_with", "o_"), ("ends_with", "key")])


@query(
    "T5_drop_empty",
    f"""WITH {fx.MESSY} SELECT segment, balance FROM messy WHERE trim(segment) <> '' OR trim(balance) <> ''""",
)
def _t5(t: Tables) -> DataFrame:
    return cl.drop_empty_columns(cl.drop_empty_rows(fx.messy_customers(t).select("segment", "balance", "notes")))


@query("T6_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem")
def _t6(t: Tables) -> DataFrame:
    return cl.distinct_rows(t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity", "l_discount"))


@query(
    "T7_where",
    """SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal >= 500 AND c_acctbal <> 1863.84
      AND contains(lower(c_name), '#0000') AND NOT contains(lower(c_mktsegment), 'mach') AND c_nationkey IN (1, 2, 3, 5, 8, 13)""",
)
def _t7(t: Tables) -> DataFrame:
    terms = [("c_acctbal", ">=", 500), ("c_acctbal", "!=", "1863.84"), ("c_name", "like", "%#0000%"),
             ("c_mktsegment", "not like", "MACH%"), ("c_nationkey", "in", [1, 2, 3, 5, 8, 13]), ("c_name", "is not", None)]
    return cl.where(t.customer, terms).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@query("T8_select_alias", "SELECT c_custkey AS id, c_name AS label, c_acctbal AS c_acctbal FROM customer")
def _t8(t: Tables) -> DataFrame:
    return cl.project(t.customer, [("c_custkey", "id"), ("c_name", "label"), "c_acctbal"])


@query(
    "T9_calculated_column",
    """SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, round(CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END, 8) AS unit,
      round(CASE WHEN l_discount <> 0 THEN l_tax / l_discount * 100 END, 6) AS tax_share,
      round(log2(l_quantity), 6) AS lg,
      round((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / (SELECT stddev_samp(l_extendedprice) FROM lineitem), 6) AS z FROM lineitem""",
)
def _t9(t: Tables) -> DataFrame:
    df = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    df = cl.add_calculated_column(df, "l_extendedprice", "divide", "l_quantity", name="unit", digits=8)
    df = cl.add_calculated_column(df, "l_tax", "percent", "l_discount", name="tax_share")
    df = cl.add_calculated_column(df, "l_quantity", "log2", name="lg")
    df = cl.add_calculated_column(df, "l_extendedprice", "zscore", name="z")
    return df.drop("l_quantity", "l_discount", "l_tax")


@query(
    "T10_filter_stream",
    f"WITH {fx.SEQS} SELECT * FROM seqs WHERE length(sequence) >= 128 AND contains(sequence, 'ACG') AND regexp_matches(title, 'seq\\d*7 ')",
)
def _t10(t: Tables) -> DataFrame:
    df = cl.filter_stream(fx.sequences(t), "length", ">=", 128)
    df = cl.filter_stream(df, "sequence", "contains", "ACG")
    return cl.filter_stream(df, "title", "matches", r"seq\d*7 ")


@query(
    "T11_search_text",
    """WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    p AS (SELECT doc_id, n, string_split(lower(line), 'the') AS pieces, line FROM lines WHERE contains(lower(line), 'the')),
    m AS (SELECT doc_id, n, line, i, length(array_to_string(pieces[1:i], 'the')) + 1 AS s FROM (SELECT *, unnest(range(1, len(pieces))) AS i FROM p))
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, s) AS "match", cast(n as bigint) AS line, s AS "start", s + 2 AS "end", substr(line, s, 3) AS matched_text, 'le' AS replacement FROM m""",
)
def _t11(t: Tables) -> DataFrame:
    return tx.search_text(t.documents, "text", "the", "le", keys=["doc_id"])


@query("T12_replace_text", "SELECT doc_id, replace(replace(replace(replace(text, 'the', 'le'), 'The', 'le'), 'THE', 'le'), 'tHe', 'le') AS text FROM documents")
def _t12(t: Tables) -> DataFrame:
    return tx.replace_text(t.documents.select("doc_id", "text"), "text", "the", "le")


@query(
    "T12_extract_matches",
    "SELECT doc_id, array_to_string(regexp_extract_all(text, '[0-9]+'), ', ') AS numbers FROM documents",
)
def _t12b(t: Tables) -> DataFrame:
    df = t.documents.select("doc_id", "text")
    return tx.extract_matches(df, "text", "[0-9]+", delimiter=", ", mode="regex", name="numbers").drop("text")


@query(
    "T12_remove_matching_lines",
    "SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT contains(lower(x), 'license')), chr(10)) AS text FROM documents",
)
def _t12c(t: Tables) -> DataFrame:
    return tx.remove_matching_lines(t.documents.select("doc_id", "text"), "text", "license")


_JOIN_COLUMNS = "l.cust, l.id, l.status, l.total, r.id AS id_right, r.status AS status_right, r.nation"


def _join(t: Tables, how: str) -> DataFrame:
    return jo.join_tables(fx.keyed_orders(t), fx.keyed_customers(t), ["cust"], ["customer"], how)


@query("J1_join_inner", f"WITH {fx.JOIN_PAIR} SELECT {_JOIN_COLUMNS} FROM l JOIN r ON l.k = r.k")
def _j1(t: Tables) -> DataFrame:
    return _join(t, "inner")


@query("J1_join_left", f"WITH {fx.JOIN_PAIR} SELECT {_JOIN_COLUMNS} FROM l LEFT JOIN r ON l.k = r.k")
def _j1b(t: Tables) -> DataFrame:
    return _join(t, "left")


@query(
    "J2_join_full",
    f"WITH {fx.JOIN_PAIR} SELECT coalesce(l.cust, r.customer) AS cust, l.id, l.status, l.total, r.id AS id_right, r.status AS status_right, r.nation FROM l FULL JOIN r ON l.k = r.k",
)
def _j2(t: Tables) -> DataFrame:
    return _join(t, "full")


@query(
    "J3_join_diagnostics",
    f"""WITH {fx.JOIN_PAIR}, b AS (SELECT 'left' AS side, k FROM l UNION ALL SELECT 'right', k FROM r), g AS (SELECT side, k, count(*) AS n FROM b GROUP BY 1, 2)
    SELECT side, cast(sum(n) as bigint) AS "rows", cast(coalesce(sum(n) FILTER (k IS NULL), 0) as bigint) AS incomplete_key_rows,
      count(*) FILTER (k IS NOT NULL AND n > 1) AS duplicate_key_groups FROM g GROUP BY 1""",
)
def _j3(t: Tables) -> DataFrame:
    return jo.join_diagnostics(fx.keyed_orders(t), fx.keyed_customers(t), ["cust"], ["customer"])


def _ids(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(F.concat(F.lit("seq"), (k * 3).cast("string")).alias("query"), k.alias("list_pos"))


IDS = "ids AS (SELECT 'seq' || (s_suppkey * 3) AS query, s_suppkey AS list_pos FROM supplier)"


@query(
    "J4_extract_by_id_keep",
    f"WITH {fx.SEQS}, {IDS} SELECT * FROM seqs WHERE string_split(title, ' ')[1] IN (SELECT query FROM ids)",
)
def _j4(t: Tables) -> DataFrame:
    return jo.extract_by_id(fx.sequences(t), _ids(t))


@query(
    "J4_extract_by_id_remove",
    f"WITH {fx.SEQS}, {IDS} SELECT * FROM seqs WHERE string_split(title, ' ')[1] NOT IN (SELECT query FROM ids)",
)
def _j4b(t: Tables) -> DataFrame:
    return jo.extract_by_id(fx.sequences(t), _ids(t), action="remove")


@query(
    "J4_extract_title_contains",
    f"WITH {fx.SEQS}, {IDS} SELECT * FROM seqs WHERE EXISTS (SELECT 1 FROM ids WHERE contains(seqs.title, ids.query))",
)
def _j4c(t: Tables) -> DataFrame:
    return jo.extract_by_id(fx.sequences(t), _ids(t), mode="title_contains", record_key=["record"])


@query(
    "J4_id_match_report",
    f"""WITH {fx.SEQS}, {IDS}, f AS (SELECT query, count(record) AS records FROM ids LEFT JOIN seqs ON contains(title, query) GROUP BY list_pos, query)
    SELECT query, records, CASE records WHEN 0 THEN 'missing' WHEN 1 THEN 'single' ELSE 'multiple' END AS status FROM f""",
)
def _j4d(t: Tables) -> DataFrame:
    return jo.id_match_report(fx.sequences(t), _ids(t), mode="title_contains")


@query(
    "J8_mate_pairs",
    f"""WITH {fx.READS}, r2 AS (SELECT read_id, CASE WHEN read_id % 11 = 0 THEN 'other' ELSE 'read' END || read_id || '/2' AS title, sequence, quality FROM reads WHERE substr(sequence, 1, 1) <> 'A')
    SELECT read_id, a.title AS title_1, a.sequence AS sequence_1, a.quality AS quality_1, b.title AS title_2, b.sequence AS sequence_2, b.quality AS quality_2,
      CASE WHEN b.title IS NULL THEN 'unpaired' WHEN read_id % 11 = 0 THEN 'name_mismatch' ELSE 'matched' END AS pair_status FROM reads a LEFT JOIN r2 b USING (read_id)""",
)
def _j8(t: Tables) -> DataFrame:
    first = fx.reads(t)
    second = first.filter(~F.col("sequence").startswith("A")).withColumn(
        "title", F.concat(F.when(F.col("read_id") % 11 == 0, "other").otherwise("read"), F.col("read_id").cast("string"), F.lit("/2"))
    )
    return jo.mate_pairs(first, second, ["read_id"])


@query(
    "A1_group_by",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, count(l_shipdate) AS dated, round(sum(l_extendedprice), 2) AS total,
      round(avg(l_quantity), 6) AS mean_qty, min(l_discount) AS low, max(l_discount) AS high FROM lineitem GROUP BY 1, 2""",
)
def _a1(t: Tables) -> DataFrame:
    out = ag.group_by(t.lineitem, ["l_returnflag", "l_linestatus"], [
        ("count", None, "n"), ("count", "l_shipdate", "dated"), ("sum", "l_extendedprice", "total"), ("avg", "l_quantity", "mean_qty"),
        ("min", "l_discount", "low"), ("max", "l_discount", "high")])
    return out.withColumn("total", F.round("total", 2)).withColumn("mean_qty", F.round("mean_qty", 6))


@query(
    "A2_group_summary",
    """SELECT l_returnflag, l_linestatus, count(*) AS row_count, count(l_quantity) AS l_quantity_count, count(DISTINCT l_quantity) AS l_quantity_distinct,
      round(sum(l_quantity), 4) AS l_quantity_sum, round(avg(l_quantity), 4) AS l_quantity_mean, round(quantile_cont(l_quantity, 0.5), 4) AS l_quantity_median,
      min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max, round(stddev_samp(l_quantity), 4) AS l_quantity_sd,
      count(l_extendedprice) AS l_extendedprice_count, count(DISTINCT l_extendedprice) AS l_extendedprice_distinct, round(sum(l_extendedprice), 4) AS l_extendedprice_sum,
      round(avg(l_extendedprice), 4) AS l_extendedprice_mean, round(quantile_cont(l_extendedprice, 0.5), 4) AS l_extendedprice_median,
      min(l_extendedprice) AS l_extendedprice_min, max(l_extendedprice) AS l_extendedprice_max, round(stddev_samp(l_extendedprice), 4) AS l_extendedprice_sd
    FROM lineitem GROUP BY 1, 2""",
)
def _a2(t: Tables) -> DataFrame:
    operations = ["count", "distinct", "sum", "mean", "median", "min", "max", "sd"]
    return ag.group_summary(t.lineitem, ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"], operations, digits=4)


def _profile_sql() -> str:
    token = "('NA', 'N/A', 'na', 'n/a', 'null', 'NULL', '-')"
    nat = NATURAL.format("v")
    return f"""WITH {fx.MESSY}, long AS (SELECT 'segment' AS "column", segment AS raw FROM messy UNION ALL SELECT 'balance', balance FROM messy
      UNION ALL SELECT 'notes', notes FROM messy UNION ALL SELECT 'day', strftime(o_orderdate, '%Y-%m-%d') FROM orders
      UNION ALL SELECT 'nation', cast(c_nationkey as varchar) FROM customer),
    c AS (SELECT "column", CASE WHEN trim(raw) = '' OR trim(raw) IN {token} THEN NULL ELSE trim(raw) END AS v FROM long),
    x AS (SELECT *, CASE WHEN regexp_matches(v, {NUM}) THEN try_cast(v as double) END AS num FROM c),
    s AS (SELECT "column", count(*) AS n, count(v) AS k, count(DISTINCT v) AS d, count(num) AS nums, bool_and(regexp_matches(v, '^[+-]?\\d+$')) AS ints,
      bool_and(regexp_matches(v, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')) AS dates, avg(num) AS mean, stddev_samp(num) AS sd, min(num) AS lo, max(num) AS hi,
      quantile_cont(num, 0.25) AS q1, quantile_cont(num, 0.5) AS md, quantile_cont(num, 0.75) AS q3, min(v) AS lov, max(v) AS hiv,
      min(length(v)) AS lmin, avg(length(v)) AS lavg, max(length(v)) AS lmax FROM x GROUP BY 1),
    k AS (SELECT *, CASE WHEN k = 0 THEN 'empty' WHEN ints THEN 'integer' WHEN nums = k THEN 'number' WHEN dates THEN 'date' ELSE 'text' END AS kind FROM s),
    tops AS (SELECT "column", v, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, {nat}, v) AS r
      FROM (SELECT "column", v, count(*) AS n FROM c WHERE v IS NOT NULL GROUP BY 1, 2)),
    tj AS (SELECT "column", string_agg(v || ' (' || n || ')', '; ' ORDER BY r) AS top FROM tops WHERE r <= 3 GROUP BY 1)
    SELECT "column", kind AS inferred_type, k AS non_missing_count, n - k AS missing_count, round((n - k) / n * 100, 2) AS missing_percent,
      d AS distinct_count, CASE WHEN k > 0 THEN round(d / k * 100, 2) END AS distinct_percent,
      CASE WHEN kind IN ('integer', 'number') THEN round(mean, 6) END AS mean, CASE WHEN kind IN ('integer', 'number') THEN round(sd, 6) END AS sd,
      CASE WHEN kind IN ('integer', 'number') THEN cast(lo as varchar) WHEN kind = 'date' THEN lov END AS min,
      CASE WHEN kind IN ('integer', 'number') THEN round(q1, 6) END AS q1, CASE WHEN kind IN ('integer', 'number') THEN round(md, 6) END AS median,
      CASE WHEN kind IN ('integer', 'number') THEN round(q3, 6) END AS q3,
      CASE WHEN kind IN ('integer', 'number') THEN cast(hi as varchar) WHEN kind = 'date' THEN hiv END AS max,
      CASE WHEN kind = 'text' THEN lmin END AS min_length, CASE WHEN kind = 'text' THEN round(lavg, 6) END AS mean_length, CASE WHEN kind = 'text' THEN lmax END AS max_length,
      coalesce(top, '') AS top_values FROM k LEFT JOIN tj USING ("column")"""


@query("A3_profile_table", _profile_sql())
def _a3(t: Tables) -> DataFrame:
    people = ag.profile_table(fx.messy_customers(t), ["segment", "balance", "notes"], top_k=3)
    days = ag.profile_table(t.orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")), top_k=3)
    nations = ag.profile_table(t.customer.select(F.col("c_nationkey").alias("nation")), top_k=3)
    return people.unionByName(days).unionByName(nations)


def _describe_sql() -> str:
    def one(c: str) -> str:
        return f"""SELECT '{c}' AS "column", count(v) AS count, count(*) - count(v) AS missing, round(sum(v), 2) AS sum, round(avg(v), 6) AS mean, cast(10 as double) AS trim_percent,
      (SELECT round(avg(v), 6) FROM (SELECT v, row_number() OVER (ORDER BY v) AS r, count(*) OVER () AS n FROM lineitem_{c}) WHERE r > floor(n * 0.1) AND r <= n - floor(n * 0.1)) AS trimmed_mean,
      round(quantile_cont(v, 0.5), 6) AS median, round(stddev_samp(v), 6) AS sd, round(stddev_samp(v) / sqrt(count(v)), 6) AS se,
      round(skewness(v), 6) AS skewness, round(kurtosis(v), 6) AS excess_kurtosis, round(stddev_samp(v) / abs(avg(v)) * 100, 6) AS cv_percent,
      min(v) AS min, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, max(v) AS max, round(max(v) - min(v), 6) AS range,
      round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, round(mad(v), 6) AS mad,
      (SELECT count(*) FROM lineitem_{c}, (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM lineitem_{c}) WHERE v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) AS outlier_count_iqr
      FROM lineitem_{c}"""

    columns = ["l_quantity", "l_extendedprice", "l_tax"]
    views = ", ".join(f"lineitem_{c} AS (SELECT {c} AS v FROM lineitem)" for c in columns) + ", lineitem_c_acctbal AS (SELECT c_acctbal * c_acctbal AS v FROM customer)"
    return f"WITH {views} " + " UNION ALL ".join(one(c) for c in [*columns, "c_acctbal"])


@query("A4_describe_numeric", _describe_sql())
def _a4(t: Tables) -> DataFrame:
    lines = ag.describe_numeric(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"])
    balance = ag.describe_numeric(t.customer.select((F.col("c_acctbal") * F.col("c_acctbal")).alias("c_acctbal")), ["c_acctbal"])
    out = lines.unionByName(balance).withColumn("sum", F.round("sum", 2))
    return out.drop("mean_ci_95_low", "mean_ci_95_high")


@query(
    "A5_list_counts",
    """WITH i AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN '  ' || p_name ELSE p_name END AS item, p_partkey AS o FROM part)
    SELECT arg_min(trim(item), o) AS item, count(*) AS count FROM i GROUP BY lower(trim(item))""",
)
def _a5(t: Tables) -> DataFrame:
    return tx.list_counts(_spelled_parts(t), "item", "o")


def _spelled_parts(t: Tables) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    return t.part.select(
        F.when(k % 3 == 0, F.upper(name)).when(k % 3 == 1, F.concat(F.lit("  "), name)).otherwise(name).alias("item"), k.alias("o")
    )


@query(
    "A6_word_counts",
    f"""WITH w AS (SELECT regexp_replace(unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}''-]*')), '^[-'']+|[-'']+$', '', 'g') AS word FROM documents),
    c AS (SELECT word, count(*) AS n FROM w WHERE length(word) >= 3 AND word NOT IN ({", ".join(f"'{w}'" for w in tx.STOP_WORDS)}) GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY n DESC, word) AS rank, sum(n) OVER () AS total FROM c)
    SELECT rank, word, n AS count, round(n / total * 100, 4) AS frequency_percent FROM r""",
)
def _a6(t: Tables) -> DataFrame:
    return tx.word_counts(t.documents, "text")


FLOWS = """f AS (SELECT c.n_name AS source, r.r_name AS target, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation c ON c_nationkey = c.n_nationkey JOIN region r ON c.n_regionkey = r.r_regionkey),
t AS (SELECT source, target, round(sum(value), 2) AS value FROM f WHERE value > 0 GROUP BY 1, 2)"""


def _flows(t: Tables) -> DataFrame:
    rows = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return ag.flow_totals(rows, "n_name", "r_name", "o_totalprice").withColumn("value", F.round("value", 2))


@query("A7_flow_totals", f"WITH {FLOWS} SELECT * FROM t")
def _a7(t: Tables) -> DataFrame:
    return _flows(t)


@query(
    "A7_flow_nodes",
    f"""WITH {FLOWS}, e AS (SELECT source AS label, 0 AS i, value AS o FROM t UNION ALL SELECT target, value, 0 FROM t)
    SELECT label, round(sum(i), 2) AS incoming, round(sum(o), 2) AS outgoing, round(greatest(sum(i), sum(o)), 2) AS total FROM e GROUP BY 1""",
)
def _a7b(t: Tables) -> DataFrame:
    out = ag.flow_nodes(_flows(t))
    return out.select("label", *[F.round(c, 2).alias(c) for c in ("incoming", "outgoing", "total")])


@query(
    "A8_crosstab_means",
    """SELECT p_brand AS x, p_type || '-' || p_size AS y, round(avg(p_retailprice), 6) AS value, count(*) AS count FROM part GROUP BY 1, 2""",
)
def _a8(t: Tables) -> DataFrame:
    return ag.crosstab_means(_brand_cells(t), "p_brand", "cell", "p_retailprice")


def _brand_cells(t: Tables) -> DataFrame:
    return t.part.select("p_brand", F.concat_ws("-", "p_type", "p_size").alias("cell"), "p_retailprice")


@query(
    "A8_crosstab_missing",
    """WITH c AS (SELECT DISTINCT p_brand AS x, p_type || '-' || p_size AS y FROM part)
    SELECT x, y FROM (SELECT DISTINCT x FROM c), (SELECT DISTINCT y FROM c) EXCEPT SELECT x, y FROM c""",
)
def _a8b(t: Tables) -> DataFrame:
    return ag.crosstab_missing(ag.crosstab_means(_brand_cells(t), "p_brand", "cell", "p_retailprice"))


_A9_COLUMNS = ["level_a", "level_b", "count", "percent", "statistic", "value", "mean", "sd", "min", "q1", "median", "q3", "max", "row_percent", "column_percent"]


def _a9_select(analysis: str, **given: str) -> str:
    kinds = {"level_a": "varchar", "level_b": "varchar", "count": "bigint", "statistic": "varchar"}
    parts = [f"cast({given.get(c, 'NULL')} as {kinds.get(c, 'double')}) AS \"{c}\"" for c in _A9_COLUMNS]
    return f"SELECT '{analysis}' AS analysis, " + ", ".join(parts)


def _a9_missing(a: str, b: str) -> str:
    states = {"complete pair": ("NOT", "NOT"), "column a missing": ("", "NOT"), "column b missing": ("NOT", ""), "both missing": ("", "")}
    return " UNION ALL ".join(
        _a9_select("missingness", level_a=f"'{k}'", count=f"count(*) FILTER ({x} {a} AND {y} {b})",
                   percent=f"round(count(*) FILTER ({x} {a} AND {y} {b}) / count(*) * 100, 2)") + " FROM src"
        for k, (x, y) in states.items()
    )


@query(
    "A9_compare_numeric",
    "WITH src AS (SELECT l_quantity AS a, l_extendedprice AS b FROM lineitem), m AS (SELECT corr(a, b) AS r, covar_samp(a, b) AS cv, regr_slope(b, a) AS sl, regr_intercept(b, a) AS ic, "
    "avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb, stddev_samp(b) AS sb, count(*) AS n FROM src) "
    + _a9_missing("a IS NULL", "b IS NULL") + " UNION ALL "
    + _a9_select("numeric vs numeric", statistic="'paired_n'", count="n") + " FROM m UNION ALL "
    + " UNION ALL ".join(
        _a9_select("numeric vs numeric", statistic=f"'{k}'", value=f"round({e}, 4)") + " FROM m"
        for k, e in {"pearson_r": "r", "r_squared": "r * r", "sample_covariance": "cv", "linear_slope": "sl", "linear_intercept": "ic",
                     "column_a_mean": "ma", "column_a_sd": "sa", "column_b_mean": "mb", "column_b_sd": "sb"}.items()
    ),
)
def _a9(t: Tables) -> DataFrame:
    return ag.column_comparison(t.lineitem, "l_quantity", "l_extendedprice").withColumn("value", F.round("value", 4))


@query(
    "A9_compare_numeric_category",
    f"WITH {fx.MESSY}, s0 AS (SELECT c_acctbal AS a, p AS b FROM (SELECT c_acctbal, CASE WHEN trim(segment) IN ('', 'NA', 'n/a') THEN NULL ELSE segment END AS p FROM customer JOIN messy ON sample_id = cast(c_custkey as varchar))), src AS (SELECT * FROM s0), "
    f"c AS (SELECT * FROM src WHERE a IS NOT NULL AND b IS NOT NULL), tops AS (SELECT b, row_number() OVER (ORDER BY count(*) DESC, {NATURAL.format('b')}, b) AS r FROM c GROUP BY b), "
    "g AS (SELECT a, CASE WHEN r <= 3 THEN b ELSE 'Other' END AS lev FROM c JOIN tops USING (b)) "
    + _a9_missing("a IS NULL", "b IS NULL") + " UNION ALL "
    + _a9_select("numeric vs category", level_a="lev", count="count(*)", percent="round(count(*) / (SELECT count(*) FROM c) * 100, 2)", mean="round(avg(a), 6)", sd="round(stddev_samp(a), 6)",
                 min="min(a)", q1="round(quantile_cont(a, 0.25), 6)", median="round(quantile_cont(a, 0.5), 6)", q3="round(quantile_cont(a, 0.75), 6)", max="max(a)") + " FROM g GROUP BY lev",
)
def _a9b(t: Tables) -> DataFrame:
    joined = jo.join_tables(t.customer.withColumn("id", F.col("c_custkey").cast("string")), fx.messy_customers(t), ["id"], ["sample_id"])
    return ag.column_comparison(joined, "c_acctbal", "segment", max_categories=3)


@query(
    "A9_compare_categories",
    "WITH src AS (SELECT o_orderpriority AS a, o_orderstatus AS b FROM orders), cells AS (SELECT a, b, count(*) AS n FROM src GROUP BY 1, 2) "
    + _a9_missing("a IS NULL", "b IS NULL") + " UNION ALL "
    + _a9_select("category vs category", level_a="a", level_b="b", count="n", percent="round(n / sum(n) OVER () * 100, 2)", statistic="'cell_count'", value="n",
                 row_percent="round(n / sum(n) OVER (PARTITION BY a) * 100, 2)", column_percent="round(n / sum(n) OVER (PARTITION BY b) * 100, 2)") + " FROM cells",
)
def _a9c(t: Tables) -> DataFrame:
    return ag.column_comparison(t.orders, "o_orderpriority", "o_orderstatus")


LISTS = """i AS (SELECT 0 AS list, p_brand AS item, p_partkey AS o FROM part UNION ALL SELECT 0, p_type, p_partkey + 1000000 FROM part UNION ALL SELECT 1, upper(p_name), p_partkey FROM part
  UNION ALL SELECT 1, lower(p_brand), p_partkey + 1000000 FROM part WHERE p_size > 45 UNION ALL SELECT 2, p_name, p_partkey FROM part WHERE p_size < 10
  UNION ALL SELECT 2, upper(p_brand), p_partkey + 1000000 FROM part WHERE p_size = 50),
g AS (SELECT lower(trim(item)) AS k, arg_min(trim(item), list * 10000000 + o) AS item, count(*) FILTER (list = 0) AS a, count(*) FILTER (list = 1) AS b, count(*) FILTER (list = 2) AS c FROM i GROUP BY 1),
ov AS (SELECT item, cast(a > 0 as bigint) + cast(b > 0 as bigint) + cast(c > 0 as bigint) AS list_count,
  concat_ws(',', CASE WHEN a > 0 THEN 'A' END, CASE WHEN b > 0 THEN 'B' END, CASE WHEN c > 0 THEN 'C' END) AS lists,
  'A:' || a || '; B:' || b || '; C:' || c AS counts_by_list, a + b + c AS total_count,
  CASE WHEN a > 0 THEN 'A' ELSE '-' END || CASE WHEN b > 0 THEN 'B' ELSE '-' END || CASE WHEN c > 0 THEN 'C' ELSE '-' END AS membership_key FROM g),
ovc AS (SELECT *, CASE WHEN list_count = 3 THEN 'shared_all' WHEN list_count = 1 THEN lower(lists) || '_only' ELSE 'shared_' || lower(replace(lists, ',', '')) END AS category FROM ov)"""


def _overlap(t: Tables) -> DataFrame:
    p = t.part
    later = (F.col("p_partkey") + 1000000).alias("o")
    a = p.select(F.col("p_brand").alias("item"), F.col("p_partkey").alias("o")).unionByName(p.select(F.col("p_type").alias("item"), later))
    b = p.select(F.upper("p_name").alias("item"), F.col("p_partkey").alias("o")).unionByName(
        p.filter("p_size > 45").select(F.lower("p_brand").alias("item"), later)
    )
    c = p.filter("p_size < 10").select(F.col("p_name").alias("item"), F.col("p_partkey").alias("o")).unionByName(
        p.filter("p_size = 50").select(F.upper("p_brand").alias("item"), later)
    )
    return ag.list_overlap([a, b, c], order="o")


@query("A10_list_overlap", f"WITH {LISTS} SELECT * FROM ovc")
def _a10(t: Tables) -> DataFrame:
    return _overlap(t)


@query(
    "A10_overlap_categories",
    f"WITH {LISTS} SELECT membership_key, lists, list_count, count(*) AS item_count, cast(sum(total_count) as bigint) AS total_count FROM ovc GROUP BY 1, 2, 3",
)
def _a10b(t: Tables) -> DataFrame:
    return ag.overlap_categories(_overlap(t))


@query("U2_shared_items", f"WITH {LISTS} SELECT item, lists FROM ovc WHERE category = 'shared_all'")
def _u2(t: Tables) -> DataFrame:
    return rs.shared_items(_overlap(t)).select("item", "lists")


@query("U2_unique_items", f"WITH {LISTS} SELECT item, lists FROM ovc WHERE list_count = 1")
def _u2b(t: Tables) -> DataFrame:
    return rs.unique_items(_overlap(t)).select("item", "lists")


def _copied_sequences(t: Tables) -> DataFrame:
    k = F.col("l_partkey")
    seq = F.concat(fx.dna32(k), fx.dna32(k + 1))
    from assayloom.functions.sequence import reverse_complement

    return t.lineitem.select(
        fx.line_name().alias("record"), F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("title"),
        F.when(F.col("l_linenumber") == 3, reverse_complement(seq)).when(F.col("l_linenumber") == 4, F.lower(seq)).otherwise(seq).alias("sequence"),
        F.lit(1).cast("bigint").alias("sequence_lines"),
    )


@query(
    "A11_duplicate_census",
    f"""WITH s AS (SELECT {fx.LINE_NAME} AS record, 't' || l_orderkey AS title, {fx.dna32_sql("l_partkey")} || {fx.dna32_sql("l_partkey + 1")} AS q, l_linenumber AS n FROM lineitem),
    u AS (SELECT record, title, CASE WHEN n = 3 THEN reverse(translate(q, 'ACGT', 'TGCA')) ELSE q END AS v FROM s),
    tc AS (SELECT title, count(*) AS title_count FROM u GROUP BY 1), sc AS (SELECT v, count(*) AS sequence_count FROM u GROUP BY 1),
    j AS (SELECT u.*, title_count, sc.sequence_count, x.v IS NOT NULL AND x.v <> u.v AS rc FROM u JOIN tc USING (title) JOIN sc USING (v) LEFT JOIN sc x ON x.v = reverse(translate(u.v, 'ACGT', 'TGCA')))
    SELECT record, title, length(v) AS length, cast(1 as bigint) AS sequence_lines, title_count, sequence_count,
      CASE WHEN title_count > 1 OR sequence_count > 1 OR rc THEN 'warning' ELSE 'ok' END AS status,
      concat_ws('; ', CASE WHEN title_count > 1 THEN 'duplicate title' END, CASE WHEN sequence_count > 1 THEN 'duplicate sequence' END, CASE WHEN rc THEN 'reverse-complement duplicate' END) AS issues FROM j""",
)
def _a11(t: Tables) -> DataFrame:
    return ag.duplicate_census(_copied_sequences(t), check_reverse_complement=True)


@query(
    "A11_fasta_issues",
    f"""WITH s AS (SELECT p_partkey AS k, p_partkey % 5 AS m, {fx.dna32_sql("p_partkey")} AS q FROM part),
    u AS (SELECT CASE WHEN m = 1 THEN '' ELSE 's' || k END AS title, CASE WHEN m = 4 THEN '' ELSE q END AS sequence, CASE m WHEN 4 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS n,
      CASE m WHEN 1 THEN ['missing title', 'header has leading whitespace after >'] WHEN 2 THEN ['blank sequence line', 'blank sequence line', 'sequence line contains whitespace'] WHEN 3 THEN ['header has leading whitespace after >'] WHEN 4 THEN ['empty sequence'] ELSE [] END AS issues FROM s),
    t AS (SELECT title, count(*) AS title_count FROM u GROUP BY 1), c AS (SELECT sequence, count(*) AS sequence_count FROM u WHERE sequence <> '' GROUP BY 1),
    w AS (SELECT u.*, title_count, coalesce(sequence_count, 0) AS sequence_count, array_to_string(list_concat(issues, CASE WHEN title_count > 1 THEN ['duplicate title'] ELSE [] END, CASE WHEN sequence_count > 1 THEN ['duplicate sequence'] ELSE [] END), '; ') AS notes
      FROM u JOIN t USING (title) LEFT JOIN c ON c.sequence = u.sequence)
    SELECT title, length(sequence) AS length, cast(n as bigint) AS sequence_lines, title_count, sequence_count, CASE WHEN notes = '' THEN 'ok' ELSE 'warning' END AS status, notes AS issues FROM w""",
)
def _a11b(t: Tables) -> DataFrame:
    k, q = F.col("p_partkey"), fx.dna32(F.col("p_partkey"))
    name, kind = F.concat(F.lit("s"), k.cast("string")), k % 5
    record = (
        F.when(kind == 1, F.concat(F.lit("> \n"), q)).when(kind == 2, F.concat(F.lit(">"), name, F.lit("\n"), F.substring(q, 1, 7), F.lit("\n\n \n"), F.substring(q, 8, 9), F.lit(" "), F.substring(q, 17, 16)))
        .when(kind == 3, F.concat(F.lit("> "), name, F.lit("\n"), q)).when(kind == 4, F.concat(F.lit(">"), name)).otherwise(F.concat(F.lit(">"), name, F.lit("\n"), q))
    )
    path = shared_folder(t.spark, "loose-fasta")
    t.part.select(record.alias("line")).write.text(path)
    checked = se.read_fasta_checked(t.spark, path).withColumn("record", F.lit(None).cast("bigint"))
    return ag.duplicate_census(checked).drop("record")


@query(
    "W1_sort_rows",
    f"""SELECT p_partkey, p_brand, p_size, row_number() OVER (ORDER BY {NATURAL.format("p_brand")}, p_size DESC, p_partkey) AS position FROM part""",
)
def _w1(t: Tables) -> DataFrame:
    return od.sort_rows(t.part.select("p_partkey", "p_brand", "p_size"), ["p_brand", ("p_size", "desc")], ["p_partkey"], position="position")


@query("W2_top_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _w2(t: Tables) -> DataFrame:
    return od.top_rows(t.orders.select("o_orderkey", "o_totalprice"), [("o_totalprice", "desc")], 25, ["o_orderkey"])


@query(
    "W3_average_rank",
    """WITH g AS (SELECT event_type, value, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT event_type, value, n, cast(coalesce(sum(n) OVER (PARTITION BY event_type ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) as bigint) AS before,
      coalesce(sum(n) OVER (PARTITION BY event_type ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rank FROM g""",
)
def _w3(t: Tables) -> DataFrame:
    return average_ranks(t.events, "value", ["event_type"])


@query(
    "W4_best_per_key",
    """SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS best_rank FROM orders) WHERE best_rank <= 3""",
)
def _w4(t: Tables) -> DataFrame:
    return od.best_per_key(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).withColumn(
        "best_rank", F.col("best_rank").cast("bigint"))


@query(
    "W5_sequential_positions",
    f"""WITH {fx.INTERVALS}, p AS (SELECT record, "start", name, row_number() OVER (PARTITION BY record ORDER BY "start", name) AS marker_index FROM a)
    SELECT *, row_number() OVER (ORDER BY {NATURAL.format("record")}, marker_index) AS plot_position FROM p""",
)
def _w5(t: Tables) -> DataFrame:
    return od.sequential_positions(fx.intervals_a(t).select("record", "start", "name"), "record", ["start", "name"])


@query(
    "W6_quantile_pairs",
    """WITH n AS (SELECT event_id, value, row_number() OVER (ORDER BY value, event_id) AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL),
    p AS (SELECT *, (i - 0.5) / n AS p FROM n), q AS (SELECT *, p - 0.5 AS c, sqrt(-2 * ln(least(p, 1 - p))) AS e FROM p),
    z AS (SELECT *, (((((-39.69683028665376 * c*c + 220.9460984245205) * c*c - 275.9285104469687) * c*c + 138.357751867269) * c*c - 30.66479806614716) * c*c + 2.506628277459239) * c /
      (((((-54.47609879822406 * c*c + 161.5858368580409) * c*c - 155.6989798598866) * c*c + 66.80131188771972) * c*c - 13.28068155288572) * c*c + 1) AS mid,
      (((((-0.007784894002430293 * e - 0.3223964580411365) * e - 2.400758277161838) * e - 2.549732539343734) * e + 4.374664141464968) * e + 2.938163982698783) /
      ((((0.007784695709041462 * e + 0.3224671290700398) * e + 2.445134137142996) * e + 3.754408661907416) * e + 1) AS tail FROM q)
    SELECT event_id, i, round(p, 8) AS probability, round(CASE WHEN p < 0.02425 THEN tail WHEN p > 1 - 0.02425 THEN -tail ELSE mid END, 5) AS theoretical_quantile, value AS sample_quantile FROM z""",
)
def _w6(t: Tables) -> DataFrame:
    out = od.quantile_pairs(t.events, "value", ["event_id"])
    return out.withColumn("probability", F.round("probability", 8)).withColumn("theoretical_quantile", F.round("theoretical_quantile", 5))


@query("W8_sample_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(o_orderkey || '|7') LIMIT 500")
def _w8(t: Tables) -> DataFrame:
    return od.sample_rows(t.orders.select("o_orderkey", "o_totalprice"), 500, 7, ["o_orderkey"])


@query(
    "W8_sample_rows_with_replacement",
    """WITH p AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY md5(o_orderkey || '|7'), o_orderkey) AS place FROM orders),
    d AS (SELECT i AS draw, cast('0x' || substr(md5(i || '|7'), 1, 15) as bigint) % (SELECT count(*) FROM orders) + 1 AS pick FROM (SELECT unnest(range(500)) AS i))
    SELECT draw, o_orderkey, o_totalprice FROM d JOIN p ON pick = place""",
)
def _w8b(t: Tables) -> DataFrame:
    return od.sample_rows(t.orders.select("o_orderkey", "o_totalprice"), 500, 7, ["o_orderkey"], replacement=True)


@query(
    "W11_unique_sorted_list",
    f"""WITH i AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN '  ' || p_name ELSE p_name END AS item, p_partkey AS o FROM part),
    u AS (SELECT arg_min(trim(item), o) AS item, min(o) AS o FROM i GROUP BY lower(trim(item)))
    SELECT item, o, row_number() OVER (ORDER BY {NATURAL.format("lower(item)")}, o) AS place FROM u""",
)
def _w11(t: Tables) -> DataFrame:
    unique = tx.unique_list(_spelled_parts(t), "item", "o")
    return numbered(unique, [*tx.list_order(F.col("item")), F.col("o")], "place")


@query(
    "U1_gather",
    "SELECT c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier UNION ALL SELECT p_name, NULL FROM part",
)
def _u1(t: Tables) -> DataFrame:
    return rs.gather([
        t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")),
        t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), "s_suppkey"),
        t.part.select(F.col("p_name").alias("name")),
    ])


@query(
    "U3_pivot_wider",
    """SELECT l_suppkey, round(sum(l_extendedprice) FILTER (l_returnflag || l_linestatus = 'AF'), 2) AS "AF", round(sum(l_extendedprice) FILTER (l_returnflag || l_linestatus = 'NF'), 2) AS "NF",
      round(sum(l_extendedprice) FILTER (l_returnflag || l_linestatus = 'NO'), 2) AS "NO", round(sum(l_extendedprice) FILTER (l_returnflag || l_linestatus = 'RF'), 2) AS "RF",
      round(sum(l_extendedprice) FILTER (l_returnflag || l_linestatus = 'AO'), 2) AS "AO", round(sum(l_extendedprice) FILTER (l_returnflag || l_linestatus = 'RO'), 2) AS "RO" FROM lineitem GROUP BY 1""",
)
def _u3(t: Tables) -> DataFrame:
    df = t.lineitem.withColumn("flags", F.concat("l_returnflag", "l_linestatus"))
    out = rs.pivot_wider(df, ["l_suppkey"], "flags", "l_extendedprice", duplicate="sum", order="l_orderkey")
    return out.select("l_suppkey", *[F.round(c, 2).alias(c) for c in out.columns[1:]])


@query(
    "U3_pivot_wider_first",
    """WITH f AS (SELECT user_id, event_type, arg_min(cast(value as varchar), event_id) AS v FROM events GROUP BY 1, 2)
    SELECT user_id, max(v) FILTER (event_type = 'view') AS view, max(v) FILTER (event_type = 'signup') AS signup, max(v) FILTER (event_type = 'click') AS click,
      max(v) FILTER (event_type = 'error') AS error, max(v) FILTER (event_type = 'purchase') AS purchase FROM f GROUP BY 1""",
)
def _u3b(t: Tables) -> DataFrame:
    return rs.pivot_wider(t.events, ["user_id"], "event_type", "value", duplicate="first", order="event_id")


@query(
    "U4_pivot_longer",
    """SELECT c_custkey, 'c_name' AS name, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer
    UNION ALL SELECT c_custkey, 'c_nationkey', cast(c_nationkey as varchar) FROM customer""",
)
def _u4(t: Tables) -> DataFrame:
    return rs.pivot_longer(t.customer, ["c_custkey"], ["c_name", "c_mktsegment", "c_nationkey"])


@query(
    "U5_split_records",
    "SELECT doc_id, cast(generate_subscripts(string_split(text, chr(10)), 1) - 1 as int) AS item_index, unnest(string_split(text, chr(10))) AS line FROM documents",
)
def _u5(t: Tables) -> DataFrame:
    df = t.documents.select("doc_id", F.split("text", "\n").alias("lines"))
    return rs.split_records(df, "lines", "line")


