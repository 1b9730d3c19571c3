"""Token files, filter audit and conversation repair against plain versions."""

import itertools
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest

from assayloom.llm import conversations, filter_audit, token_files
from assayloom.llm.queries import QUERIES, tokenizer_path
from tests.llm import cases

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def reference():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizer_path())


def expected_tokens(reference, rows):
    """Rows of op11 for (doc_id, text) in file order."""
    out, before = [], 0
    for key, text in rows:
        ids = np.array([*reference.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        out.append((key, before, len(ids), zlib.crc32(ids.tobytes())))
        before += len(ids)
    return out


def test_token_files_equal_the_library(spark, reference):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in QUERIES["op11_token_files"](spark, FOLDER).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == expected_tokens(reference, sorted((r["doc_id"], r["text"]) for r in docs))


def test_token_files_odd_rows(spark, reference, tmp_path):
    docs = cases.edges(spark)
    manifest = token_files.write_tokens(docs, f"{tmp_path}/a", tokenizer_path())
    rows = token_files.read_tokens(spark, f"{tmp_path}/a").orderBy("start").collect()
    assert len(rows) == docs.count() == sum(s["documents"] for s in manifest["shards"])
    keys = [r["key"] for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    texts = sorted((repr(i), t or "") for i, t, *_ in cases.edge_rows())
    want = sorted((k, reference.encode(t, add_special_tokens=False).ids + [1]) for k, t in texts)
    assert sorted((repr(r["key"]), np.frombuffer(r["token_ids"], dtype="<u4").tolist()) for r in rows) == want
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1].tolist()]
    assert [x.tolist() for x in token_files.read_document(f"{tmp_path}/a", 7)] == [reference.encode("word", add_special_tokens=False).ids + [1]]
    assert len(token_files.read_document(f"{tmp_path}/a", 5)) == 2 and len(token_files.read_document(f"{tmp_path}/a", None)) == 2 and token_files.read_document(f"{tmp_path}/a", 99) == []


def test_token_files_without_rows_and_with_text_keys(spark, reference, tmp_path):
    assert token_files.write_tokens(cases.empty(spark), f"{tmp_path}/none", tokenizer_path())["shards"] == []
    assert token_files.read_tokens(spark, f"{tmp_path}/none").count() == 0
    docs = spark.createDataFrame([(f"k{i % 7}é", "one two " * i) for i in range(40)], "doc_id string, text string")
    token_files.write_tokens(docs, f"{tmp_path}/text", tokenizer_path(), end_id=None)
    rows = token_files.read_tokens(spark, f"{tmp_path}/text").orderBy("start").collect()
    assert [r["key"] for r in rows] == sorted(f"k{i % 7}é" for i in range(40)) and sum(r["n_tokens"] for r in rows) == 2 * sum(range(40))
    assert len(token_files.read_document(f"{tmp_path}/text", "k3é")) == 6
    with pytest.raises(ValueError):
        token_files.write_tokens(docs.selectExpr("array(doc_id) AS doc_id", "text"), f"{tmp_path}/x", tokenizer_path())


def test_token_files_need_their_dictionary(spark, tmp_path):
    token_files.write_tokens(cases.edges(spark), f"{tmp_path}/a", tokenizer_path())
    (tmp_path / "a" / token_files.DICTIONARY).write_bytes(b"another dictionary")
    with pytest.raises(ValueError):
        token_files.read_tokens(spark, f"{tmp_path}/a")
    with pytest.raises(ValueError):
        token_files._check_head(token_files.MARK + bytes(32), b"content")


def test_hot_key_is_split(spark, tmp_path):
    docs = spark.createDataFrame([(1, "same text here")] * 3000 + [(i, f"text {i}") for i in range(2, 500)], "doc_id bigint, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one shard
    try:
        manifest = token_files.write_tokens(docs, f"{tmp_path}/a", tokenizer_path())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(s["documents"] for s in manifest["shards"]) == 3498 and max(s["documents"] for s in manifest["shards"]) < 3000


def test_positional_counts():
    random = np.random.default_rng(1)
    for size in (0, 1, 2, 3, 4, 100, 5000):
        words = random.integers(0, 1 << 32, size, dtype=np.uint32)
        assert filter_audit.positional_counts(words).tolist() == [int((words >> np.uint32(b) & np.uint32(1)).sum()) for b in range(32)]
    table = filter_audit.survival_words()
    assert all(bool(table[m] >> s & 1) == (m & s == 0) for m in range(32) for s in range(32))


def plain_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for key, text, part in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        fails = set()
        fails |= {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text or "") > 3 * len(text or "") else set()
        fails |= {"D"} if set(text or "") & set("#$%&*|") else set()
        fails |= {"E"} if key is not None and any(k is not None and k < key and (t or "") == (text or "") for k, t, _ in docs) else set()
        rows.append((key, part or "", fails))
    out = {}
    for part in {p for _, p, _ in rows}:
        mine = [(k, f) for k, p, f in rows if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [(k, f) for k, f in left if name in f]
                left = [(k, f) for k, f in left if name not in f]
                total[name] += len(gone)
                failing = sum(name in f for _, f in mine)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(f == {name} for _, f in mine), sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone), name]
        for place, values in out.items():
            if place[0] == part:
                values[-1] = total[values[-1]]
    return out


def test_filter_audit_equals_brute_force(spark):
    docs = cases.edges(spark)
    marks = [(1, 1, 0), (2, 0, 1), (5, 1, 1), (5, 0, 0), (6, 1, None), (7, None, 1), (12, 1, 1), (None, 1, 1), (99, 1, 1)]
    labels = spark.createDataFrame([(*m, "own") for m in marks], "doc_id bigint, quality int, toxic int, part string")
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in filter_audit.audit_filters(docs, labels).collect()}
    assert got == plain_audit([(r[0], r[1], r[2]) for r in cases.edge_rows()], marks)
    assert filter_audit.audit_filters(cases.empty(spark), labels).count() == 0
    assert filter_audit.audit_filters(docs, labels.limit(0)).filter("good_lost > 0 OR toxic_lost > 0").count() == 0


GOOD = re.compile(r"(s?(ua)+)?")


def all_edits(rows):
    """Cheapest cost and least audit by trying all edits."""
    best = None
    gaps = ["", "u", "a", "ua", "au", "uaua", "aua"]
    for between in itertools.product(gaps, repeat=len(rows) + 1):
        for edits in itertools.product("KDua", repeat=len(rows)):
            cost, audit, roles = 5 * len(between[0]), "I" * len(between[0]), between[0]
            for (initial, fault), edit, gap in zip(rows, edits, between[1:]):
                if edit == "D":
                    cost, audit = cost + 2, audit + "D"
                elif fault in (1, 2) or edit == "K" and not initial:
                    cost = None
                    break
                else:
                    roles += initial if edit == "K" else edit
                    cost += (edit != "K") + 5 * (fault == 3)
                    audit += "K" if edit == "K" else "R"
                cost, audit, roles = cost + 5 * len(gap), audit + "I" * len(gap), roles + gap
            if cost is not None and GOOD.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def by_rows(rows, start=0, ends=(0, 3)):
    """The same, row by row with whole labels for each state."""
    def inserted(reach):
        for _ in range(4):
            for state in list(reach):
                after, label = conversations.INSERTED[state], (reach[state][0] + 5, reach[state][1] + "I")
                reach[after] = min(reach.get(after, label), label)
        return reach

    reach = inserted({start: (0, "")})
    for row in rows:
        new = {}
        for state, (cost, audit) in reach.items():
            for after, more, letter in conversations.row_edges(state, row):
                label = (cost + more, audit + letter)
                new[after] = min(new.get(after, label), label)
        reach = inserted(new)
    return min((reach[e] for e in ends if e in reach), default=None)


def test_search_equals_all_edits():
    kinds = [(i, f) for i in ("s", "u", "a", "t", "") for f in (0, 1, 3)]
    for size in (0, 1):
        for rows in itertools.product(kinds, repeat=size):
            assert conversations.cheapest(list(rows), 0, (0, 3)) == all_edits(list(rows)) == by_rows(list(rows))
    random = np.random.default_rng(2)
    for _ in range(25):
        rows = [kinds[i] for i in random.integers(0, len(kinds), 2)]
        assert conversations.cheapest(rows, 0, (0, 3)) == all_edits(rows)
    for _ in range(300):
        rows = [kinds[i] for i in random.integers(0, len(kinds), random.integers(0, 30))]
        for start in range(4):
            for ends in ((0, 3), (0,), (1,), (2,), (3,)):
                assert conversations.cheapest(rows, start, ends) == by_rows(rows, start, ends)


def plain_repair(table):
    """Rows of op13 for (conv, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if draw:
                text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
                rows += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in rows:
            signs = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append(1 if not signs else 2 if (role, text) in seen else 0 if signs[-1] in ".!?" else 3)
            seen.add((role, text))
        turns = [t for t, *_ in rows if t is not None]
        cost, audit = by_rows([(role[:1], f) for (_, role, _), f in zip(rows, faults)])
        lines, rest, roles = [], iter(rows), ""
        for letter in audit:
            role, text = (None, "") if letter == "I" else next(rest)[1:]
            if letter == "D":
                continue
            role = role if letter == "K" else "assistant" if roles[-1:] == "u" else "user"
            lines.append(f"{role}:{text}")
            roles += role[:1]
        assert GOOD.fullmatch(roles)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversation_rows():
    random = np.random.default_rng(3)
    texts = ["Yes.", "No!", "cut off", "", None, " \n", "why? \t", "Ünï.", "."]
    table = []
    for conv in range(60):
        for turn in range(int(random.integers(1, 9))):
            role = str(random.choice(["user", "assistant", "system", "tool", "", "x"], p=[0.4, 0.35, 0.1, 0.05, 0.05, 0.05]))
            table.append((conv, turn if random.random() < 0.9 else None, role if role != "x" else None, texts[int(random.integers(0, len(texts)))]))
    long = [(1000, t, "user" if t % 2 == 0 else "assistant", f"turn {t % 400}" + "." * (t % 7 > 0)) for t in range(1500)]
    same = [(1001, 5, "user", "Again.")] * 700
    dropped = [(c, 0, "user", "Gone.") for c in range(2000, 2100)]
    return table + long + same + dropped + table[:5] + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, None, None, None)]


@pytest.mark.parametrize("block", [256, 4])
def test_conversation_repair_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    rows = conversation_rows()
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'own' AS conv", "'own' AS audit", "'own' AS part", "'own' AS print", "'own' AS copies")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r["conv_id"]: tuple(r[n] for n in names) for r in conversations.repair_damaged(frame).collect()}
    want = plain_repair(rows)
    assert any(v[-2] == "" for v in want.values()) and len(want[1000][-2]) > 1400
    assert got == want
    assert conversations.repair_damaged(frame.limit(0)).count() == 0


def test_undamaged_conversations(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello!"), (2, 0, "user", "Hi."), (2, 2, "user", "Hi there?")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv"]: (r["cost"], r["audit"], r["gaps"]) for r in conversations.repair(conversations.plain_rows(frame)).collect()}
    assert got == {1: (0, "KKK", 0), 2: (1, "KR", 1)}
