"""Language identification and toxicity: held-out accuracy and edge cases."""

from __future__ import annotations

import math

import numpy as np
import pytest

from semaspark.llm import langid, queries, toxicity

FIXTURE = "/root/testdata/sf0.01"


def test_automaton_parses_into_longest_phrases():
    text = np.array([1, 2, 1, 2, 3])
    table = langid.automaton(text, 5)

    def phrases(s):
        state, n = 0, 1
        for c in s:
            got = table[state, c]
            n, state = n + (got & 1), got >> 1
        return n

    def brute(s):
        n, cur, hay = 1, "", "12123"
        for c in map(str, s):
            if cur + c in hay:
                cur += c
            else:
                n, cur = n + 1, c if c in hay else ""
        return n

    rng = np.random.default_rng(0)
    for _ in range(300):
        s = rng.integers(1, 5, rng.integers(0, 12)).tolist()
        assert phrases(s) == brute(s), s


def test_language_edge_cases(spark):
    rows = [(i, "the quick brown fox and the lazy dog " * 3, "en", 1) for i in range(20)] + [(i + 50, "der schnelle braune fuchs und der faule hund " * 3, "de", 1) for i in range(20)]
    rows += [(90, None, "en", 1), (91, "", "de", 1), (92, "123 !!", None, 1), (93, "und der hund", None, 1), (93, "und der hund", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = langid.learn(df, df.doc_id >= 0)
    out = {(r.doc_id, r.lang_pred) for r in langid.identify(df, model, keep=["doc_id"]).collect()}
    assert {(90, "und"), (91, "und"), (92, "und"), (93, "de"), (3, "en"), (53, "de")} <= out
    assert langid.identify(df.limit(0), model).count() == 0
    none = langid.learn(df.limit(0), df.doc_id >= 0)
    assert {r.lang_pred for r in langid.identify(df, none, keep=["doc_id"]).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FIXTURE}/documents.parquet").select("doc_id", "lang")
    got = queries.op4_language_cross_parsing(spark, FIXTURE).where("held_out").join(docs, "doc_id").collect()
    assert len(got) > 150 and sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def _letters(text, known=None):
    """Letters in lower case, one blank for what lies between; unknown letters as one sign."""
    out = " "
    for c in text or "":
        c = (c.lower() if known is None or c.lower() in known else "\0") if c.isalpha() else " "
        out += "" if c == out[-1] == " " else c
    return out


def test_language_query_equals_naive_parsing(spark, monkeypatch):
    """Every document of a table, by searching the labelled texts as strings."""
    texts, learn, model = {}, langid.learn, langid.Model

    def noting(*args, **how):
        with monkeypatch.context() as m:
            m.setattr(langid, "Model", lambda t: texts.update(t) or model(t))
            return learn(*args, **how)

    monkeypatch.setattr(langid, "learn", noting)
    path = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    got = queries.op4_language_cross_parsing(spark, path).collect()
    assert len(got) == len(docs) and len(texts) > 1
    known = {c for t in texts.values() for c in t.lower() if c.isalpha()}
    hay = {k: _letters(t) for k, t in sorted(texts.items())}

    def cost(s, h):
        n = 0
        for at in range(0, len(s), langid.LANE):
            n, phrase = n + 1, ""
            for c in s[at : at + langid.LANE]:
                if phrase + c in h:
                    phrase += c
                else:
                    n, phrase = n + 1, c if c in h else ""
        return n * math.log2(len(h))

    for r in got:
        s = _letters(docs[r.doc_id], known)
        bits = {k: cost(s, h) for k, h in hay.items()}
        least = min(bits.values())
        if not s.strip():
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        assert r.lang_pred == next(k for k in hay if bits[k] == least), r.doc_id
        assert r.score == pytest.approx(1 / sum(math.exp(-min((b - least) * 0.1, 50)) for b in bits.values())), r.doc_id


@pytest.fixture(scope="module")
def model():
    text = "you are an idiot and a moron said the silly person who went to the market with a lot of the trash in the morning " * 50
    return toxicity.CharModel(toxicity.count_grams([text]))


@pytest.mark.parametrize(("token", "word"), [("1d1ot", "idiot"), ("i.d.i.o.t", "idiot"), ("m0r0n", "moron"), ("idiiiiot", "idiot"), ("tr@$h", "trash")])
def test_restoration(model, token, word):
    assert toxicity.doubtful(token)
    assert word in toxicity.Restorer(model).words(token)
    assert word in toxicity.restore(f"an {token}", model)


def test_plain_tokens_have_one_reading(model):
    assert not toxicity.doubtful("market") and toxicity.restore("the market, 12 of 30!", model) == "the market, 12 of 30!"
    assert toxicity.Restorer(model).text(None) == [] and toxicity.restore(None, model) == ""
    assert "idiot" in toxicity.Restorer(model, frozenset(["idiot"])).text("such an i d i o t here")


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{FIXTURE}/labels.parquet")
    got = queries.op7_toxicity_noisy_channel(spark, FIXTURE)
    assert got.count() == spark.read.parquet(f"{FIXTURE}/documents.parquet").count()
    rows = got.where("held_out").join(labels, "doc_id").collect()
    clean = [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)
    insults = [r for r in rows if r.toxic and r.marked]
    assert insults and all(r.predicted for r in insults)


def test_toxicity_without_labels(spark, model):
    df = spark.createDataFrame([(1, "x", 0.5), (2, None, 0.5), (2, None, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    scorer = toxicity.learn(df, labels, labels.doc_id > 0, model)
    out = toxicity.score(df, model, scorer, keep=["doc_id"], restored=True).collect()
    assert [r.score for r in out] == [0.0] * 3 and {r.restored for r in out} == {"x", ""}
    assert toxicity.score(df.limit(0), model, scorer).count() == 0


@pytest.mark.parametrize(("token", "word"), [("$tupid", "stupid"), ("!diot", "idiot"), ("(lown", "clown"), ("*diot", "idiot"), ("stupid$", "stupids")])
def test_disguise_at_the_edges(token, word):
    own = toxicity.CharModel(toxicity.count_grams(["the stupid idiot and the clown saw stupids " * 50]))
    assert toxicity.doubtful(token)
    assert word in toxicity.Restorer(own, frozenset([word])).words(token)
    assert word in toxicity.restore(f"an {token}", own)
    assert toxicity.restore("(the clown!", own) == "(the clown!"


def test_reading_is_the_likeliest_of_all():
    """Long runs of signs with many contexts, against the search of all readings."""
    own = toxicity.CharModel(toxicity.count_grams(["a bee or an ox is in us at one inn " * 3]))
    logp = own.logp

    def brute(token):
        best = (-1e9, "")
        stack = [(0, "", 0.0, (0, 0, 0), "")]
        while stack:
            i, text, p, (x, y, z), before = stack.pop()
            if i == len(token):
                best = max(best, (p + float(logp[x, y, z, 0]), text.strip()))
                continue
            c = token[i]
            f = toxicity.fold(c)
            if f.isalpha():
                ways = [(0.0, f)] + [(-1.0, "")] * (f == before)
            else:
                ways = [(-2.0, o) for o in toxicity.LOOKALIKES.get(c, "")] + [(-3.0 if c in toxicity._SEPARATORS else -4.0, ""), (-2.5, " ")]
            for cost, o in ways:
                if not o or (o == " " and z == 0):
                    stack.append((i + 1, text, p + cost, (x, y, z), f))
                else:
                    s = toxicity._symbol(o)
                    stack.append((i + 1, text + o, p + cost + float(logp[x, y, z, s]), (y, z, s), f))
        return best

    for token in ("b****", "*****x", "i***s"):
        assert own.read(token) == brute(token)[1]


def _scripts():
    """Languages of five scripts, two of them of one; rarer ones beyond the commonest 62 letters."""
    rng = np.random.default_rng(2)
    alphabets = {"en": range(97, 123), "ru": range(0x430, 0x450), "el": range(0x3B1, 0x3CA), "zh": range(0x4E00, 0x5200), "ja": range(0x5200, 0x5600), "ka": range(0x10D0, 0x10F1)}
    words = {k: ["".join(chr(c) for c in rng.choice(list(a), 4)) for _ in range(150)] for k, a in alphabets.items()}
    return {k: (" ".join(rng.choice(w, 3000 if k in ("en", "ru") else 400)), [" ".join(rng.choice(w, 8)) for _ in range(20)]) for k, w in words.items()}


def test_languages_of_several_scripts(monkeypatch):
    texts = _scripts()
    model = langid.Model({k: t for k, (t, _) in texts.items()})
    held = [(k, t) for k, (_, own) in texts.items() for t in own]
    got, score, _ = model.identify([t for _, t in held])
    assert got == [k for k, _ in held]
    monkeypatch.setattr(langid, "DENSE", 0)
    sparse = langid.Model({k: t for k, (t, _) in texts.items()})
    assert all(t.table is None for t in sparse.tables)
    again, same, _ = sparse.identify([t for _, t in held])
    assert again == got and np.array_equal(same, score)
