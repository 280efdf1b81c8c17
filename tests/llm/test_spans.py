"""Personal data and secrets against the plain patterns."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from semaspark.llm import pii, queries, secrets


def brute_pii(text: str) -> list[tuple[str, int, int]]:
    rx = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def good(kind: str, s: str) -> bool:
        digits = re.sub(r"[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            odd = sum(map(int, digits[-1::-2])) + sum(sum(map(int, str(2 * int(d)))) for d in digits[-2::-2])
            return 16 <= len(digits) <= 19 and odd % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, r in rx.items() for m in re.finditer(r, text or "") if good(k, m[0])]


def brute_secrets(text: str) -> list[tuple[str, int, int]]:
    rx = [
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 12),
        ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 18), ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 16),
    ]
    out = [(m.start(), i, k, m.end()) for i, (k, r, f, ok) in enumerate(rx) for m in re.finditer(r, text or "", f) if ok(m)]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def _digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-+ ()1234567890.%é", max_size=60))
def test_base_personal_data(text):
    got = [(pii.KINDS[k], s, e) for k, spans in enumerate(pii.base_spans(text)) for s, e in spans]
    assert got == brute_pii(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["token", "Secret", "api_key", "=", ":", " ", '"', "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef", "é", ".", "ſecret"]), max_size=14).map("".join))
def test_base_secrets(text):
    assert [(secrets.KINDS[k], s, e) for s, k, e, _ in secrets.base_spans(text)] == brute_secrets(text)


def test_queries_match_brute_force_on_all_documents(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for run, brute, kinds in ((queries.op1_pii_weak_supervision, brute_pii, pii.KINDS), (queries.op8_secret_randomness, brute_secrets, secrets.KINDS[:3])):
        rows = run(spark, sf).collect()
        assert sorted(r.doc_id for r in rows) == sorted(docs)
        for r in rows:
            want = brute(docs[r.doc_id])
            assert r.base_sha256 == _digest(want)
            assert [r[f"n_{k}"] for k in kinds] == [sum(x[0] == k for x in want) for k in kinds]
            assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(filter(None, r.spans.split(",")))


def test_labelers_add_what_the_patterns_miss(spark):
    rows = [(i, f"call me, phone (743) 555-{i:04d} or mail x{i}@mail.example.com, tel +1 (743) 555-{i:04d}", "k") for i in range(200)]
    rows += [(900, None, "k"), (901, "", "k"), (902, "version 1.2.3 no 4111 1111 1111 1112", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii string")
    out = {r.doc_id: r.pii for r in pii.find(df, keep=["doc_id"]).collect()}
    assert out[900] == out[901] == [] and out[902] == []
    assert [(s.kind, s.base) for s in out[5]] == [("email", True), ("phone", False), ("phone", True)]
    assert pii.find(df.limit(0), keep=["doc_id"]).count() == 0


def test_reliabilities_follow_agreement():
    f = lambda s, g, c: pii._feature(0, (s, g, c), 20)
    p = pii.weigh({f(1, 1, 1): 500, f(0, 0, 0): 500, f(1, 1, 2): 50, f(0, 0, 2): 50, f(1, 0, 2): 5})
    assert p[f(1, 1, 1)] > 0.9 > 0.1 > p[f(0, 0, 0)] and p[f(1, 1, 2)] > 0.5 > p[f(0, 0, 2)]
    assert pii.weigh({}) == {}


def test_battery_tells_random_from_text():
    rng = np.random.default_rng(3)
    random_ = secrets.battery(rng.integers(0, 64, (300, 40)), 64)
    words = "therearemanyordinarywordsinthissentenceandmoreofthem" * 4
    text = np.array([[secrets._CODE[4][c] for c in words[i : i + 40]] for i in range(100)])
    assert np.median(random_) < 12 < 40 < np.median(secrets.battery(text, 64))


def test_random_keys_are_found_and_masked(spark):
    rng = random.Random(5)
    alphabet = secrets.ALPHABETS[4][:62]
    key = lambda: "".join(rng.choice(alphabet) for _ in range(40)) + "7"
    words = ["ordinary", "words", "make", "sentences", "about", "many", "things", "and", "others"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(400)) + f" {key()} end") for i in range(60)] + [(99, None), (98, "some_snake_case_name_2 x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.secrets for r in secrets.find(df, keep=["doc_id"]).collect()}
    found = sum(any(s.kind == "random" for s in out[i]) for i in range(60))
    assert found >= 50 and out[99] == [] and out[98] == []
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert sum(secrets.MASK in clean[i] for i in range(60)) == found and clean[99] is None


def test_mask_merges_overlaps():
    assert secrets.mask("abcdefghij", [{"start": 1, "end": 4}, {"start": 2, "end": 3}, {"start": 6, "end": 8}]) == f"a{secrets.MASK}ef{secrets.MASK}ij"


def test_rests_and_short_texts_give_windows():
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("etaoinshrdlu") for _ in range(n))
    per = lambda texts: secrets.text_windows(texts).reshape(len(secrets.ALPHABETS), len(secrets.LENGTHS), -1).sum(2)
    assert per([letters(180)]).tolist() == [[1] * 5] * 5
    assert per([letters(300)]).tolist() == [[2, 2, 2, 2, 1]] * 5  # 120 more: 20, 24, 32, 40
    assert per([letters(18)] * 10).tolist() == [[1] * 5] * 5
    assert per([letters(100)]).sum(1).tolist() == [4] * 5  # 20, 24, 32 and of 24 left one of 24
    assert per(["", None, "é!", letters(19)]).sum() == 0


def test_class_without_windows_takes_the_next_shorter():
    null = np.zeros(secrets.CELLS, dtype=np.int64)
    null[100] = 1000  # digits, 20 long
    long = 4 * secrets.BINS  # digits, 64 long
    assert secrets.accepted(null, {long + 5: 3, long + 110: 3}, 0.05) == [long + 5]
    assert secrets.accepted(np.zeros(secrets.CELLS, dtype=np.int64), {long + 5: 3}, 0.05) == []


def test_letter_keys_in_short_records_are_found(spark):
    rng = random.Random(6)
    key = lambda: "".join(rng.choice(secrets.ALPHABETS[4][:52]) for _ in range(40))
    words = ["ordinary", "words", "make", "sentences", "about", "many", "things", "and", "others"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(12))) for i in range(3000)] + [(9000 + i, f"key {key()} end") for i in range(40)]
    out = {r.doc_id: r.secrets for r in secrets.find(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), keep=["doc_id"]).collect()}
    assert sum(bool(out[9000 + i]) for i in range(40)) >= 30 and not any(out[i] for i in range(3000))
