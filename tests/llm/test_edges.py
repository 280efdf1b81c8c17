"""Odd rows and columns, very long tokens, and decoding against brute force."""

from __future__ import annotations

import math
import time

import numpy as np
import pytest

from semaspark.llm import bpe, chat, common, licenses, pii, secrets, toxicity


def test_addresses_with_thousands_of_zeros(spark):
    zeros = "0" * 5_000
    rows = [(1, f"{zeros}1.2.3.4 and {zeros}.0.0.{zeros}9"), (2, f"1.2.3.{zeros}300"), (3, f"{'9' * 5_000}.1.1.1")]
    got = {r.k: [s.kind for s in r.pii if s.base] for r in pii.find(spark.createDataFrame(rows, "k long, text string"), keep=["k"]).collect()}
    assert got == {1: ["ip", "ip"], 2: [], 3: []}


def test_names_of_columns_do_not_clash(spark):
    rows = [(1, "password = abcdefghijkl1", "a/LICENSE", "h", "n", "v"), (2, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "candidates long, text string, path string, header string, n string, vector string")
    df = df.selectExpr("*", "'s' AS found_spans", "'w' AS window_counts", "'q' AS secrets", "'d' AS _dir", "'i' AS _is", "'b' AS best", "'x' AS words", "'p' AS piece")
    assert pii.find(df).columns == [*df.columns, "pii"] and pii.find(df).where("candidates = 1").first().header == "h"
    clean = {r.candidates: r for r in secrets.redact(df).collect()}
    assert clean[1].secrets == "q" and clean[1].text == secrets.MASK and clean[2].text is None and secrets.redact(df).columns == df.columns
    found = licenses.scan(df)
    assert found.columns == [*[c for c in df.columns if c != "text"], "license", "cosine", "origin"] and found.where("candidates = 1").first().n == "n"
    assert licenses.scan(df.limit(0)).count() == 0 and secrets.redact(df.limit(0)).count() == 0


def test_snapshots_of_tied_turns_collapse(spark):
    rows = [(i, 1, "user", f"{c} {i % 10}") for i in range(10) for c in "ab"] + [(100 + i, 1, "user", f"a {i}") for i in range(10)]
    rows += [(200, 1, "user", None), (201, 1, "user", ""), (201, 2, "user", "x")]
    got = chat.format_chats(spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn int, role string, text string, k int")).collect()
    assert sorted(r.conv_id for r in got) == [*range(10), 200, 201]


def exhaustive(model: toxicity.CharModel, token: str) -> float:
    """The log probability of the likeliest reading, by trying all."""

    def go(i: int, before: str, context: tuple[int, int, int]) -> float:
        if i == len(token):
            return float(model.logp[(*context, 0)])
        c, f = token[i], toxicity.fold(token[i])
        if f.isalpha():
            ways = [(0.0, f)] + [(-1.0, "")] * (f == before)
        else:
            ways = [(-2.0, x) for x in toxicity.LOOKALIKES.get(c, "")] + [(-3.0 if c in toxicity._SEPARATORS else -4.0, ""), (-2.5, " ")]
        best = -math.inf
        for cost, out in ways:
            if not out or (out == " " and context[2] == 0):
                best = max(best, cost + go(i + 1, f, context))
            else:
                s = toxicity._symbol(out)
                best = max(best, cost + float(model.logp[(*context, s)]) + go(i + 1, f, (*context[1:], s)))
        return best

    return go(0, "", (0, 0, 0))


def test_viterbi_is_exact_and_linear():
    model = toxicity.CharModel(toxicity.count_grams(["you are an idiot and a silly clown, a total loser", "nice people like the books"] * 20))
    for token in ("1d10t", "c**wn", "l0s3r!", "i-d-i-o-t", "s1llyyy", "$1|*y", "***", "a.b*c1"):
        assert model.decode(token)[0] == pytest.approx(exhaustive(model, token), abs=1e-6), token
    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        model.read("id1ot" * (n // 5))
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5


def test_other_tokenizers_are_refused(tmp_path):
    import json

    import public_tokenizers

    spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": spec["model"] | {"ignore_merges": True}}):
        (tmp_path / "t.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="tokenizer file"):
            bpe.ByteBpe(str(tmp_path / "t.json"))


def test_tidy_leaves_what_the_result_reads(spark, tmp_path):
    from pathlib import Path

    at = Path(common.shared_dir(spark).removeprefix("file:"))
    before = set(at.glob("semaspark-*"))

    @common.tidy
    def made():
        a = common.materialise(spark.range(5).toDF("x"))
        return common.materialise(a.where("x > 1"))

    out = made()
    assert len(set(at.glob("semaspark-*")) - before) == 1 and out.count() == 3
    assert np.all(np.array([r.x for r in out.orderBy("x").collect()]) == [2, 3, 4])
