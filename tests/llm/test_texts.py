"""BPE, quality, toxicity, languages and host rules: exact comparisons, held-out accuracy, odd rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from assayloom.llm import bpe, host_rules, languages, quality, toxicity
from assayloom.llm.queries import QUERIES, tokenizer_path
from tests.llm import cases

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def reference():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizer_path())


def check_ids(reference, rows):
    for row in rows:
        want = reference.encode(row["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(row["token_ids"], dtype="<u4").tolist() == want
        assert row["n_tokens"] == len(want) and row["decoded"] == reference.decode(want, skip_special_tokens=False)


def test_bpe_equals_the_library(spark, reference):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    check_ids(reference, bpe.encode_documents(docs, tokenizer_path(), keep=("text",)).collect())


def test_bpe_odd_rows_and_clashing_columns(spark, reference):
    docs = cases.edges(spark)
    rows = bpe.encode_documents(docs, tokenizer_path(), keep=tuple(docs.columns)).collect()
    assert len(rows) == docs.count() and rows[0]["label"] == "own"
    check_ids(reference, rows)
    assert bpe.digest(bpe.encode_documents(cases.empty(spark), tokenizer_path())).count() == 0


def test_guesses_are_checked_and_failures_merged():
    model = bpe.Bpe(**bpe.read_tokenizer(tokenizer_path()))
    words = [w for w in ("ththereandnd", "unbelievableness", "a", "zzzzqqqq", "keitkeit", "thisisnotaword", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa")]
    assert model.encode_words(words) == model.merge(words)
    assert any(model.guess(w) != m for w, m in zip(words, model.merge(words)))


def test_quality_accuracy_and_thresholds(spark):
    rows = QUERIES["op2_quality_classifier"](spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").collect()
    for row in rows:
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0)
        assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.3)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.9


def test_quality_trees_walk_like_single_documents():
    random = np.random.default_rng(1)
    x = random.random((400, len(quality.STATISTICS)))
    y = (x[:, 3] + x[:, 5] > 1).astype(float)
    model = quality.fit_trees(x, y)

    def slow(row):
        margin = model["start"]
        for feature, cut, leaf in zip(model["feature"], model["cut"], model["leaf"]):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > cut[node])
            margin += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-margin))

    assert np.allclose(quality.walk_trees(model, x), [slow(r) for r in x])
    assert ((quality.walk_trees(model, x) > 0.5) == y).mean() > 0.95


def test_quality_odd_rows(spark):
    docs = cases.edges(spark)
    model = quality.train(docs, cases.labels(spark))
    assert quality.score(docs, model).count() == docs.count()
    assert quality.accepted(docs, model).columns == docs.columns
    untaught = quality.train(docs, cases.labels(spark, []))
    assert {r["score"] for r in quality.score(docs, untaught).collect()} == {0.5}
    assert quality.score(cases.empty(spark), quality.train(cases.empty(spark), cases.labels(spark, []))).count() == 0


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.learn(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").filter("held_out").collect()
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    clean, toxic = [r for r in rows if not r["toxic"]], [r for r in rows if r["toxic"]]
    assert np.mean([r["predicted"] for r in clean]) < 0.02 and np.mean([r["predicted"] for r in toxic]) > 0.7
    costs = model["costs"].tolist()
    for word in ("st.u.p.i.d", "$tupid", "5tup1d", "stuuuupid", "s-t-u-p-i-d"):
        assert "stupid" in list(toxicity.readings(word, costs))
    assert any("stupid" in toxicity.readings(t, costs) for t in toxicity.tokens("so s t u p i d"))


def test_viterbi_finds_the_cheapest_path():
    counts = toxicity.character_costs(np.random.default_rng(2).integers(0, 50, (toxicity.SIZE,) * 3).astype(float))
    costs = counts.tolist()

    def slow(word):
        paths = [((0, 0), 0.0, "")]
        for i, sign in enumerate(word):
            if sign.isalpha():
                options = [(sign, 0.0)] + ([("", toxicity.AGAIN_COST)] if i and word[i - 1] == sign else [])
            else:
                options = [(c, toxicity.LOOK_COST) for c in toxicity.LOOKS[sign]] + [("", toxicity.NOISE_COST)]
            paths = [((b, toxicity.CODE[c]), cost + more + costs[a][b][toxicity.CODE[c]], text + c) if c else ((a, b), cost + more, text) for (a, b), cost, text in paths for c, more in options]
        return min((cost + costs[a][b][0], text) for (a, b), cost, text in paths)[1]

    for word in ("b1g", "aab0", "1d10t", "c4ll3r"):
        assert toxicity.restore(word, costs) == slow(word)


def test_toxicity_odd_rows(spark):
    docs = cases.edges(spark)
    model = toxicity.learn(docs, cases.labels(spark))
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(cases.empty(spark), toxicity.learn(cases.empty(spark), cases.labels(spark, []))).count() == 0


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = QUERIES["op9_language_id"](spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) >= 0.95 and all(0 <= r["score"] <= 1 for r in rows)


def test_phrases_are_longest_matches():
    texts = {"x": "abracadabra cadabra banana", "y": "bandana ananas abba"}
    codes = languages.letter_codes(list(texts.values()))
    folds = {n: languages.folded(t, codes) for n, t in texts.items()}
    parser = languages.Parser({"names": list(texts), "moves": [languages.suffix_automaton(f.tolist()) for f in folds.values()], "codes": codes})
    asked = ["banabra anana cad", "abbadabra", "zzz bana"]
    total, sizes = parser.phrases(asked)
    for text, counts, size in zip(asked, total, sizes):
        f = bytes(languages.folded(text, codes))
        assert size == len(f)
        for taught, count in zip(folds.values(), counts):
            at, phrases = 0, 0
            while at < len(f):
                end = at + 1
                while end < len(f) and f[at : end + 1] in bytes(taught):
                    end += 1
                phrases, at = phrases + 1, end
            assert phrases == count


@pytest.mark.parametrize("cells, plain", [(1, 32_000_000), (8_000_000, 0), (8_000_000, 20_000), (8_000_000, 32_000_000)])
def test_phrases_go_on_across_stretches(monkeypatch, cells, plain):
    monkeypatch.setattr(languages, "CELLS", cells)
    monkeypatch.setattr(languages, "PLAIN_CELLS", plain)
    random = np.random.default_rng(3)
    letters = "abcdefгдежз漢字"
    draw = lambda n, size: "".join(random.choice(list(letters[:size]), n))
    taught = {"x": draw(900, 4) + " " + draw(300, 13), "y": draw(700, 13), "z": "ab" * 400}
    asked = [draw(2000, 4), draw(2100, 13), taught["x"] * 2, "ab" * 1500, "q" * 600, "a", "ba" * 128, draw(3000, 2) + taught["z"]]
    codes = languages.letter_codes(list(taught.values()))
    folds = {n: languages.folded(t, codes) for n, t in taught.items()}
    parser = languages.Parser({"names": list(taught), "moves": [languages.suffix_automaton(f.tolist()) for f in folds.values()], "codes": codes})
    total, sizes = parser.phrases(asked)
    for text, counts, size in zip(asked, total, sizes):
        f = bytes(languages.folded(text, codes))
        assert size == len(f)
        for own, count in zip(folds.values(), counts):
            at, phrases = 0, 0
            while at < len(f):
                end = at + 1
                while end < len(f) and f[at : end + 1] in bytes(own):
                    end += 1
                phrases, at = phrases + 1, end
            assert phrases == count


def test_languages_of_six_scripts_and_uneven_teaching(spark):
    random = np.random.default_rng(5)
    scripts = {"en": ("abcdefghijklmnopqrstuvwxyz", 60), "ru": ("абвгдежзийклмнопрстуфхцчшщъыьэюя", 60), "el": ("αβγδεζηθικλμνξοπρστυφχψω", 60), "ka": ("აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ", 25),
               "hy": ("աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆ", 25), "he": ("אבגדהוזחטיכלמנסעפצקרשת", 25), "zh": ("".join(map(chr, range(0x4E00, 0x5600))), 25)}
    rows = []
    for name, (letters, n) in scripts.items():
        words = ["".join(random.choice(list(letters), random.integers(2, 8))) for _ in range(150)]
        rows += [(len(rows) + k, " ".join(random.choice(words, 40)), name) for k in range(n)]
    rows += [(100_000 + k, text, "xx") for k, text in enumerate([None, "", *["ћђ " * 9_000] * 6])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = {r["doc_id"]: r for r in languages.identify(docs, languages.learn(docs)).collect()}
    assert all(found[i]["lang_pred"] == (lang if text else "und") for i, text, lang in rows)


def test_languages_odd_rows(spark):
    docs = cases.edges(spark)
    rows = {r["doc_id"]: r for r in languages.identify(docs, languages.learn(docs)).collect()}
    assert [rows[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3 and rows[1]["lang_pred"] in ("de", "en")  # taught the same text
    nothing = languages.learn(docs.filter("lang IS NULL"))
    assert {r["lang_pred"] for r in languages.identify(docs, nothing).collect()} == {"und"}
    assert languages.identify(cases.empty(spark), languages.learn(cases.empty(spark))).count() == 0


def test_host_rules_counts(spark):
    docs = cases.edges(spark)
    rows = host_rules.judge_documents(docs).collect()
    assert len(rows) == docs.count()
    texts = {i: t for i, t, *_ in cases.edge_rows() if i is not None}
    for row in rows:
        if row["doc_id"] is None:
            continue
        text = texts[row["doc_id"]] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(zip(words, words[1:], words[2:]))
        repeated = {i + j for i in range(len(words) - 2) for j in range(3) if windows[tuple(words[i : i + 3])] > 1}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (row["n_words"], row["word_chars"], row["n_symbols"]) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text))
        assert (row["n_dup_lines"], row["n_repeat_words"]) == (len(lines) - len(set(lines)), len(repeated))
        assert row["base_failed"] == (len(words) < 50 or 100 * len(repeated) > 50 * len(words)) and (not row["kept"] or not row["base_failed"])


def test_bad_hosts_go_and_small_ones_are_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "few words"
    rows = [(i, good if i % 10 else bad, "h0") for i in range(200)] + [(1000 + i, bad if i % 20 else good, "h1") for i in range(200)] + [(2000, bad, "h2"), (2001, good, "h2"), (2002, good, None)]
    judged = host_rules.judge_documents(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    hosts = {r["host"]: r["host_kept"] for r in judged.select("host", "host_kept").distinct().collect()}
    assert hosts == {"h0": True, "h1": False, "h2": True, None: True}
    assert host_rules.judge_documents(cases.empty(spark)).count() == 0
