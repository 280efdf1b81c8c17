"""Chats, licences and the pipeline."""

from __future__ import annotations

import corpus_pipeline

from semaspark.llm import chat, licenses, ngram_join, queries


def brute_chats(rows):
    by = {}
    for c, t, role, text in rows:
        if c is not None and t is not None:
            by.setdefault(c, []).append((t, role or "", text or "", role is None, text is None))
    seqs = {c: tuple(x[1:] for x in sorted(v)) for c, v in by.items()}
    kept = {c for c, s in seqs.items() if not any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values())}
    return {min(c for c in kept if seqs[c] == seqs[k]): (len(seqs[k]), sum(seqs[c] == seqs[k] for c in kept)) for k in kept}


def test_snapshots_collapse(spark):
    turns = [("user", "hi"), ("assistant", "hello"), ("user", "how"), ("assistant", "fine")]
    rows = [(c, t, *turns[t]) for c, n in ((1, 1), (2, 3), (3, 4), (4, 4), (5, 2)) for t in range(n)]
    rows += [(6, 0, "user", "hi"), (6, 1, "assistant", "other"), (7, 0, None, None), (8, 0, "", ""), (9, 0, "user", None), (None, 0, "user", "x"), (10, None, "user", "x")]
    rows += [(11, 0, "user", "twice"), (11, 0, "user", "twice"), (12, 0, "user", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    out = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert {c: (r.n_turns, r.copies) for c, r in out.items()} == brute_chats(rows)
    assert out[6].rendered == "<|user|>\nhi\n<|end|>\n<|assistant|>\nother\n<|end|>\n"
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: (r.n_turns, r.copies) for r in queries.op3_chat_snapshot_collapse(spark, sf).collect()}
    assert got == brute_chats(rows)


def test_templates_match_themselves(spark):
    df = spark.createDataFrame([(n, f"code\n{t}\nmore code") for n, t in licenses.TEMPLATES.items()], "name string, text string")
    assert all(r.license == r.name and r.cosine > 0.99 for r in licenses.match(df).collect())


def test_inheritance_takes_the_nearest_directory(spark):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]
    rows = [
        ("LICENSE", mit), ("a/b/COPYING", gpl), ("a/x.py", "code"), ("a/b/c/y.py", "code"), ("a/b/own.py", licenses.TEMPLATES["Apache-2.0"]), ("top.py", ""), ("z/n.py", None),
        ("a/b/c/LICENSE.txt", "no words of that kind"), (None, "code"), ("a/x.py", "code"),
    ]
    df = spark.createDataFrame([(*r, "q") for r in rows], "path string, text string, license string")
    got = {r.path: (r.license, r.origin) for r in licenses.scan(df).collect()}
    assert got == {
        "LICENSE": ("MIT", "own"), "a/b/COPYING": ("GPL-3.0", "own"), "a/x.py": ("MIT", ""), "a/b/c/y.py": ("GPL-3.0", "a/b"), "a/b/own.py": ("Apache-2.0", "own"),
        "top.py": ("MIT", ""), "z/n.py": ("MIT", ""), "a/b/c/LICENSE.txt": ("GPL-3.0", "a/b"), None: (None, None),
    }
    assert licenses.scan(df).count() == len(rows) and licenses.scan(df.limit(0)).count() == 0


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start, at = {r.doc_id: r for r in docs.collect()}, docs
    odd = spark.createDataFrame([(10**9, None, None, None, None), (10**9 + 1, "12 34", "en", "s", 5)], docs.schema)
    at = docs.unionByName(odd)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = at.count()
        at = stage(spark, at, sf).persist()
        assert at.count() <= before
        if i < 4:
            assert at.columns == docs.columns
        if i == 0:
            assert {r.doc_id for r in at.collect()} == {k for k, r in start.items() if any(c.isalpha() for c in r.text or "")}
        if i == 1:
            again = ngram_join.join(at)
            assert again.where("n_links > 0").count() == 0
    assert at.where("NOT round_trip").count() == 0 and at.where("size(ids) <> n_tokens").count() == 0
    assert corpus_pipeline.run(spark, sf).count() == at.count()


def test_repeated_ids_leave_one_row(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11), (None, "x y z", "en", "s", 5), (None, "x y z", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [0, 1]


def test_real_licence_texts_notices_and_tags(spark):
    """Whole texts as distributions ship them, their notices and SPDX tags."""
    from pathlib import Path

    common = Path("/usr/share/common-licenses")
    rows = [(f"{n}/LICENSE", (common / f).read_text(), n) for n, f in (("Apache-2.0", "Apache-2.0"), ("BSD-3-Clause", "BSD"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-3.0", "LGPL-3"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"))]
    mit = dict(licenses.texts()[:8])["MIT"].replace("<year> <copyright holders>", "2019 Jane Doe and others")
    rows += [("MIT/COPYING", mit, "MIT"), ("MIT/sub/x.py", "code", "MIT"), ("n/mit.c", "\n".join(f" * {line}" for line in mit.split("\n")) + "\n */\n\nint main() {}", "MIT")]
    apache = '# Copyright 2020 Jane Doe\n#\n# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n# Unless required by applicable law or agreed to in writing, software\n# distributed under the License is distributed on an "AS IS" BASIS,\n# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n# See the License for the specific language governing permissions and\n# limitations under the License.\n\nimport os\n'
    gpl = "/* This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n *\n * This program is distributed in the hope that it will be useful,\n * but WITHOUT ANY WARRANTY; without even the implied warranty of\n * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the\n * GNU General Public License for more details.\n */\n\nint x;\n"
    rows += [("n/a.py", apache, "Apache-2.0"), ("n/g.c", gpl, "GPL-3.0"), ("n/s.c", "// SPDX-License-Identifier: MIT\nint x;", "MIT"), ("n/t.c", "/* SPDX-License-Identifier: GPL-2.0-only */\nint x;", "GPL-2.0"), ("n/u.c", "# SPDX-License-Identifier: MIT OR Apache-2.0\nx", "MIT OR Apache-2.0"), ("n/plain.c", "int main() {}", None), ("p/LICENSE", "the river ran past the old mill and the road to the town", None)]
    got = {r.path: r.license for r in licenses.scan(spark.createDataFrame(rows, "path string, text string, want string")).collect()}
    assert got == {p: w for p, _, w in rows}
