"""Near-duplicates, embeddings, line dedup, URL rules, mixing and the pipeline against plain versions."""

import re
from itertools import combinations

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from assayloom.llm import components, embeddings, line_dedup, mixing, near_duplicates, url_rules
from assayloom.llm.queries import QUERIES, URL_RULES
from tests.llm import cases


def plain_components(ids, links):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components(spark):
    random = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in random.integers(0, 300, (180, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 60)]
    found = {r["id"]: r["component"] for r in components.connected(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    for node, label in plain_components({x for p in links for x in p}, links).items():
        assert found.get(node, node) == label
    assert components.connected(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_components_of_many_runs(spark, monkeypatch):
    monkeypatch.setattr(components, "RUN", 64)
    random = np.random.default_rng(12)
    links = [(int(a), int(b)) for a, b in random.integers(0, 900, (700, 2))] + [(2000 + i, 2001 + i) for i in range(300)] + [(5000, 5000 + i) for i in range(1, 400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few links would be one run
    try:
        found = {r["id"]: r["component"] for r in components.connected(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for node, label in plain_components({x for p in links for x in p}, links).items():
        assert found.get(node, node) == label


def plain_sets(texts):
    out = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        out.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    return out


@pytest.mark.parametrize("block", [128, 3])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    random = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(500)]
    bases = [random.choice(vocabulary, 150).tolist() for _ in range(6)]
    rows = []
    for i in range(90):
        words = list(bases[i % 6])
        for at in random.integers(0, 150, i % 9):
            words[at] = str(random.choice(vocabulary))
        rows.append((i, " ".join(words)))
    rows += [(200, "One two"), (201, "one TWO"), (202, None), (203, ""), (204, " \n"), (205, rows[0][1]), (206, "a b c d e f"), (207, "a b c d e g")]
    got = {r["doc_id"]: r for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    sets = dict(zip([i for i, _ in rows], plain_sets([t for _, t in rows])))
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for i, label in plain_components(sets, links).items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), label, label == i)


def test_registers_merge_and_estimate():
    random = np.random.default_rng(5)
    values = random.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.unique(values[:2200]), np.unique(values[800:])
    ra, rb = near_duplicates.registers(a), near_duplicates.registers(b)
    assert (near_duplicates.merged(ra, rb) == near_duplicates.registers(np.union1d(a, b))).all()
    guess = near_duplicates.likely_similarity(ra[None], rb[None], np.array([2200.0]), np.array([2200.0]))[0]
    assert abs(guess - 1400 / 3000) < 0.2
    counts = near_duplicates.common_counts([a, b, a[:10]])
    assert counts[0, 1] == len(np.intersect1d(a, b)) and counts[0, 2] == 10


def test_near_duplicates_at_another_percent(spark):
    random = np.random.default_rng(10)
    words = [[f"v{x}" for x in random.integers(0, 9000, 100)] for _ in range(8)]
    # Two words in the middle touch ten of 96 shingles: 86 common ones of 106 in all, 0.81.
    rows = [(i, " ".join(w)) for i, w in enumerate(words)] + [(100 + i, " ".join([*w[:30], "x", *w[31:60], "y", *w[61:]])) for i, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {percent: {r["doc_id"] for r in near_duplicates.near_duplicates(docs, percent=percent).filter("kept").collect()} for percent in (80, 85)}
    assert kept == {80: set(range(8)), 85: {i for i, _ in rows}}
    assert (near_duplicates.bands_for(85), near_duplicates.bands_for(80)) == (20, 28)


def test_near_duplicates_odd_rows(spark):
    docs = cases.edges(spark)
    rows = near_duplicates.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 5)} == {1} and all(r["kept"] for r in rows if r["doc_id"] in (2, 3, 4))
    assert near_duplicates.near_duplicates(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("block", [128, 4])
def test_embeddings_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    random = np.random.default_rng(6)
    rows = []
    for i in range(40):
        center = random.standard_normal(16)
        for j in range(1 + (i % 5) * (i % 7)):
            rows.append((center + random.standard_normal(16) * 0.035 * (i % 3)).tolist())
    table = [(i, v, i % 2 if i % 50 else None) for i, v in enumerate(rows)] + [(5000, rows[1], 1), (5001, rows[1], 1), (5002, [2 * x for x in rows[1]], 1)]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 0.0], [1.0, 0.0], [1e300, 0.0]]
    table += [(6000 + i, v, 1) for i, v in enumerate(odd)] + [(None, rows[1], 1)]
    frame = spark.createDataFrame(table, "vec_id bigint, embedding array<double>, label int").selectExpr("*", "'own' AS id", "'own' AS unit", "'own' AS place")
    got = {r["vec_id"]: r for r in embeddings.near_embeddings(frame).collect()}
    usable = {i: (np.array(v) / max(map(abs, v)), lab) for i, v, lab in table if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a, b in combinations(usable, 2) if usable[a][1] == usable[b][1] and len(usable[a][0]) == len(usable[b][0]) and usable[a][0] @ usable[b][0] / np.linalg.norm(usable[a][0]) / np.linalg.norm(usable[b][0]) >= 0.98]
    labels = plain_components([i for i, *_ in table if i is not None], links)
    for i, label in labels.items():
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (sum(i in p for p in links), label, label == i)
    assert got[None]["kept"] and got[None]["n_links"] == 0
    assert embeddings.near_embeddings(frame.limit(0)).count() == 0


def test_embeddings_of_labels_with_long_equal_ends_stay_apart(spark):
    tail = "x" * 70
    rows = [(1, [1.0, 0.0], "a" + tail), (2, [1.0, 0.0], "b" + tail), (3, [1.0, 0.0], "b" + tail)]
    got = {r["vec_id"]: r for r in embeddings.near_embeddings(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")).collect()}
    assert [(got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) for i in (1, 2, 3)] == [(0, 1, True), (1, 2, True), (1, 2, False)]


def test_embeddings_joins_families_larger_than_a_list(spark):
    random = np.random.default_rng(8)
    first, across = np.linalg.qr(random.standard_normal((64, 2)))[0].T
    second = 0.985 * first + np.sqrt(1 - 0.985**2) * across
    rows = [(i, (c + random.standard_normal(64) * 0.001).tolist(), 1) for i, c in enumerate([first] * 20 + [second] * 20)]
    got = embeddings.near_embeddings(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert {(r["n_links"], r["component_id"], r["kept"]) for r in got} == {(39, 0, True), (39, 0, False)}


def test_embeddings_missed_by_seeds_are_found_exactly(spark, monkeypatch):
    for name, value in (("ORDERS", 1), ("REACH", 1), ("ROUNDS", 0), ("DRAWS", 1)):
        monkeypatch.setattr(embeddings, name, value)
    random = np.random.default_rng(9)
    topic = random.standard_normal(64) * 1.4
    rows = []
    for i in range(60):
        center = topic + random.standard_normal(64)
        rows += [(i, center), (100 + i, center + random.standard_normal(64) * 0.2)]
    units = {i: v / np.linalg.norm(v) for i, v in rows}
    links = [(a, b) for a, b in combinations(sorted(units), 2) if units[a] @ units[b] >= 0.98]
    got = {r["vec_id"]: r for r in embeddings.near_embeddings(spark.createDataFrame([(i, v.tolist(), 1) for i, v in rows], "vec_id bigint, embedding array<double>, label int")).collect()}
    assert len(links) > 50
    for i, label in plain_components(units, links).items():
        assert (got[i]["n_links"], got[i]["component_id"]) == (sum(i in p for p in links), label)


def plain_line_dedup(texts, run_words):
    """Every run of lines, of whatever length, with so many words stays where it stands first and goes elsewhere."""
    trie, seen, gone = {}, {}, {}
    for i, text in texts:
        lines = [(p, x, len(re.findall(line_dedup.WORD, x))) for p, x in enumerate(text.split("\n"))]
        lines = [x for x in lines if x[2]]
        for start in range(len(lines)):
            total, run = 0, 0
            for end in range(start, len(lines)):
                total += lines[end][2]
                run = trie.setdefault((run, lines[end][1]), len(trie) + 1)
                if total >= run_words:
                    held = seen.setdefault(run, (i, lines[end][0], lines[start][0]))
                    if (held[0], held[2]) != (i, lines[start][0]):
                        low = max(lines[start][0], held[1] + 1) if held[0] == i else lines[start][0]
                        gone.setdefault(i, set()).update(range(low, lines[end][0] + 1))
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone.get(i, ())) for i, t in texts}


def test_line_dedup_removes_runs_to_their_last_line(spark):
    line = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    copies = [[line("a", 25), line("b", 25), line("c", 3)], [line("d", 60), line("e", 20), line("f", 20)], [line("g", 3), line("h", 20), line("i", 60)]]
    texts = [(10 * i + n, "\n".join([line(f"x{i}{n}", 4), *lines, line(f"y{i}{n}", 4)])) for i, lines in enumerate(copies) for n in range(3)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_repeated_lines(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got == {k: t if k % 10 == 0 else "\n".join([t.split("\n")[0], t.split("\n")[-1]]) for k, t in texts}


def test_line_dedup_equals_brute_force(spark):
    random = np.random.default_rng(7)
    pool = [" ".join(f"w{x}" for x in random.integers(0, 900, n)) for n in random.integers(1, 30, 40)] + ["", " ", "long " * 60]
    texts = []
    for i in range(120):
        start = int(random.integers(0, len(pool)))
        lines = [pool[(start + k) % len(pool)] for k in range(int(random.integers(1, 12)))] + [str(x) for x in random.choice(pool, 3)]
        texts.append((i, "\n".join(lines)))
    got = {r["doc_id"]: r for r in line_dedup.remove_repeated_lines(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    want = plain_line_dedup(texts, line_dedup.GRAM_WORDS + line_dedup.WINDOW_WORDS - 1)
    assert {i: r["text"] for i, r in got.items()} == want and sum(r["removed_lines"] for r in got.values()) > 50


def test_line_dedup_odd_rows(spark):
    docs = cases.edges(spark)
    rows = line_dedup.remove_repeated_lines(docs).collect()
    by_id = {r["doc_id"]: r["text"] for r in rows}
    assert len(rows) == docs.count() and by_id[1] == cases.PROSE * 3 and by_id[5] == "" and by_id[2] is None and by_id[3] == ""
    assert line_dedup.remove_repeated_lines(docs, count="n").columns == [*docs.columns, "n"]
    assert line_dedup.remove_repeated_lines(cases.empty(spark)).count() == 0


def test_url_rules_equal_brute_force(spark):
    hosts = ["example.org", "www.EXAMPLE.org", "badexample.org", "a.b.com", "com", "org", "", "x.net", "example.org:80"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x", "/fr/a#b", "/de/", "?q=/es/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "://", "x://y", "http://a.com/fr/://b.org/"] + ["http://a.com/de/"] * 50
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").selectExpr("*", "'own' AS host", "'own' AS rule", "'own' AS part")
    rules = [*URL_RULES, ("block", "", "/"), ("allow", "b.com", "/fr/"), ("block", "b.com", "/fr/"), ("block", "EXAMPLE.org", "/en/12"), ("allow", None, "/")]
    got = url_rules.filter_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()
    assert len(got) == len(urls)
    for row in got:
        url = urls[row["page_id"]] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = host.lower()
        fits = [(len(h) + len(p), len(h), h.lower() + p, v) for v, h, p in rules if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == (host, path, best[2], best[3]), url
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert {r["verdict"] for r in url_rules.filter_urls(pages, none).collect()} == {"allow"}
    assert url_rules.filter_urls(pages.limit(0), none).count() == 0


def test_mixing_meets_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    targets = {"en": 0.25, "de": 0.25, "es": 0.25, "fr": 0.25}
    rows = mixing.document_rates(docs, docs, "lang", targets=targets).collect()
    p, tokens, rate = np.array([r["p"] for r in rows]), np.array([r["tokens"] for r in rows], dtype=float), np.array([r["rate"] for r in rows])
    assert np.allclose(p.sum(axis=1), 1) and (rate >= 0).all()
    assert np.allclose((p * (tokens * rate)[:, None]).sum(axis=0) / tokens.sum(), 0.25, atol=1e-3)
    assert abs((tokens * [r["copies"] for r in rows]).sum() / (tokens * rate).sum() - 1) < 0.1
    # The same steps in one array.
    plain, expected = np.ones(len(rows)), (p * tokens[:, None]).sum(axis=0)
    for _ in range(mixing.STEPS):
        have = (p * (tokens * plain)[:, None]).sum(axis=0)
        if np.abs(have - tokens.sum() / 4).max() <= mixing.TOLERANCE * tokens.sum():
            break
        plain = np.maximum(0, plain - p @ ((have - tokens.sum() / 4) / expected))
    assert np.allclose(plain, rate, atol=1e-6)
    own = dict(docs.select("doc_id", "lang").collect())
    names = sorted(targets)
    assert np.mean([names[int(np.argmax(r["p"]))] == own[r["__id"]] for r in rows]) > 0.9


def test_mixing_odd_rows(spark):
    docs = cases.edges(spark)
    mixed = mixing.mix_documents(docs, docs, "lang", budget="once")
    assert mixed.columns == docs.columns and mixed.count() <= docs.count()
    assert mixing.rate_documents(docs, docs, "lang").count() == docs.count()
    untaught = mixing.mix_documents(docs, docs.filter("lang IS NULL"), "lang")
    assert sorted(map(str, untaught.collect())) == sorted(map(str, docs.collect()))
    assert mixing.rate_documents(cases.empty(spark), docs, "lang").count() == 0
    assert mixing.rate_documents(cases.empty(spark), cases.empty(spark), "lang").count() == 0


def test_a_stray_label_does_not_set_the_budget(spark):
    random = np.random.default_rng(11)
    words = {lang: [f"{lang}{i}" for i in range(200)] for lang in ("aa", "bb", "zz")}
    rows = [(i, " ".join(random.choice(words["aa" if i % 3 else "bb"], 40)), "aa" if i % 3 else "bb") for i in range(1500)] + [(9000, " ".join(words["zz"][:40]), "zz")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    with_stray = mixing.mix_documents(docs, docs, "lang", budget="once", temperature=0.9).count()
    without = docs.filter("lang <> 'zz'")
    assert with_stray >= 0.99 * mixing.mix_documents(without, without, "lang", budget="once", temperature=0.9).count() > 1300
    assert mixing.target_totals([80.0, 19.9, 0.1], ["a", "b", "c"], {"a": 1, "b": 1, "c": 1}, "once") == [19.9, 19.9, 0.1]
    with pytest.warns(UserWarning, match="still differ"):
        mixing.fit_rates(spark.createDataFrame([(1, [0.5, 0.5])], "tokens bigint, p array<double>"), ["a", "b"], {"a": 1.0})


def test_equal_ids_keep_their_texts(spark):
    rows = [(1, None), (1, cases.PROSE), (1, cases.PROSE), (2, cases.PROSE * 2), (3, "other words altogether, as many as are needed here")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], cases.SCHEMA)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in got) == sorted([(1, ""), (1, cases.PROSE), (3, rows[-1][1])])


def test_pipeline_stages_keep_columns_and_stand_odd_rows(spark, tmp_path):
    cases.labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    for start in (cases.edges(spark), cases.edges(spark).limit(0)):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == start.columns, name
            docs = spark.createDataFrame(docs.collect(), start.schema)
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert last.count() == docs.count() and {"ids_sha256", "token_ids"} <= set(last.columns)


def test_pipeline_decisions(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = {r["doc_id"] for r in QUERIES["op2_quality_classifier"](spark, folder).filter("predicted = 1").collect()}
    kept = corpus_pipeline.keep_quality(spark, docs, folder)
    assert {r["doc_id"] for r in kept.collect()} == good
    lines = corpus_pipeline.drop_repeated_lines(spark, kept, folder).collect()
    want = plain_line_dedup(sorted((r["doc_id"], r["text"]) for r in kept.collect()), 50)
    assert {r["doc_id"]: r["text"] for r in lines} == {i: t for i, t in want.items() if re.search(line_dedup.WORD, t) or t == docs.filter(f"doc_id = {i}").first()["text"]}
    near = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(lines), folder).collect()
    sets = dict(zip([r["doc_id"] for r in lines], plain_sets([r["text"] for r in lines])))
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= corpus_pipeline.NEAR_PERCENT * len(sets[a] | sets[b])]
    assert {r["doc_id"] for r in near} == {i for i, label in plain_components(sets, links).items() if i == label}


def test_entry_registers_all():
    numbers = {int(n[2:].split("_")[0]) for n in entry.queries() if re.match(r"op\d+_", n)}
    assert numbers == set(range(1, 14)) and "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
