import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil.llm import licences as L


def said(text, model):
    p = model.probabilities(text)
    k = int(p.argmax())
    return L.UNKNOWN if k > 1 and p[k] < model.threshold else L.CLASSES[k]


def brute_paragraphs(text):
    """Lines joined to the next while they end no sentence, without the marks of comments."""
    out, held = [], None
    for line in (text or "").split("\n"):
        line = line.removesuffix("\r")
        bare = re.sub(r"^[ \t]*(?:(?:#+|//+|\*+|;+|--+|%+)[ \t]*)?", "", line)
        if held is not None and re.search(r"[^\s.!?:;][ \t]*$", held) and re.match(r"[^\s#/*;%-]", bare):
            held = f"{held.rstrip()} {bare}"
            continue
        if held is not None:
            out.append(held)
        held = line
    return [*out, held]


def brute(text, model):
    """Every paragraph asks the classifier: no gate."""
    found = [(n, said(p, model)) for n, p in enumerate(brute_paragraphs(text))]
    return [(n, f) for n, f in found if f != L.NONE]


WRAPPED = """# Permission is hereby granted, free of charge, to any person
# obtaining a copy of this software and associated documentation
# files (the "Software"), to deal in the Software without restriction

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
TEXTS = ["prose\nThis work is licensed under the GNU General Public License, version 3.\nmore", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.",
         "Licensed under the Apache License, Version 2.0.", "She renewed her driving license in May.", "Licensed under the Zorp Community License, version 9.",
         "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.", None, "", "licence " * 3000, "no such thing", "no such thing", WRAPPED,
         "one\r\n// two \r\n * three.\n-- four\n\n\n# five\n;\n", "Distributed under the Boost\nSoftware License, Version 1.0.", "\n", " \n\n x \n y"]


def test_every_notice_is_seen_and_named():
    model = L.trained()
    gate = L.look(model)
    for name, (names, ids, sentences) in L.FAMILIES.items():
        for notice in (*(f"Licensed under the {n}." for n in names), *(f"SPDX-License-Identifier: {i}" for i in ids), *sentences):
            assert re.search(gate, notice) and said(notice, model) == name, notice


@pytest.mark.parametrize("text,family", [
    ("SPDX-License-Identifier: ISC", "ISC"), ("Distributed under the Boost Software License, Version 1.0.", "Boost"), ("SPDX-License-Identifier: BSD-3-Clause", "BSD"),
    ("SPDX-License-Identifier: MPL-2.0", "MPL"), ("SPDX-License-Identifier: AGPL-3.0-only", "AGPL"), ("Licensed under the Apache License", "Apache"), ("shared under CC-BY-SA 4.0", "CC-BY-SA"),
    ("The above copyright notice and this permission notice shall be included in all copies", "MIT"), ("BSD-3-Clause", "BSD"), ("Licensed under the Zorp Community License, version 9.", "unknown"),
    ("the free software was released in version 2 of the public library", "none"), ("He works at MIT in the general public library", "none"),
])
def test_probes(text, family):
    assert said(text, L.trained()) == family


def test_recall_on_unseen_wording():
    model = L.trained()
    named = [(f, t.format(n)) for f, (names, ids, _) in L.FAMILIES.items() for n in (*names, *ids) for t in L.UNSEEN]
    got = [said(t, model) for _, t in named]
    assert np.mean([g == f for g, (f, _) in zip(got, named)]) > 0.9
    wrong = [g not in (f, L.UNKNOWN, L.NONE) for g, (f, _) in zip(got, named)]
    assert np.mean(wrong) < 0.03


def test_held_out_accuracy():
    model = L.trained()
    rows, truth = L._sentences(np.random.default_rng(99), 40)
    got = np.array([L.CLASSES.index(said(" ".join(r), model)) for r in rows])
    assert (got == truth).mean() > 0.9
    families = got > 1
    assert (truth[families] == got[families]).mean() > 0.97


def test_scan(make):
    model = L.trained()
    rows = L.scan(make(TEXTS)).orderBy("doc_id").collect()
    assert [[(x["paragraph"], x["family"]) for x in r["found"]] for r in rows] == [brute(t, model) for t in TEXTS]
    families = [[x["family"] for x in r["found"]] for r in rows]
    assert families[:7] == [["GPL"], ["CC-BY-NC"], ["MIT"], ["Apache"], [], ["unknown"], ["MIT", "Apache"]]
    assert families[12] == ["MIT", "ISC"] and families[14] == ["Boost"]
    assert all(x["confirmed"] for i in (0, 1, 2, 3, 12, 14) for x in rows[i]["found"]) and not rows[5]["found"][0]["confirmed"]


def test_paragraphs(spark):
    df = spark.createDataFrame([(t or "",) for t in TEXTS], "text string").select(L.paragraphs(F.col("text")).alias("p"))
    assert [r["p"] for r in df.collect()] == [brute_paragraphs(t) for t in TEXTS]


def test_digest_is_native(make):
    df = L.licence_digest(make(TEXTS))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    rows = df.orderBy("doc_id").collect()
    assert tuple(rows[6])[1:6] == (2, 2, "Apache,MIT", "Apache,MIT", 0) and tuple(rows[7])[1:6] == (0, 0, "", "", -1)
    assert rows[5]["families"] == "unknown" and rows[5]["confirmed_families"] == ""
    assert L.licence_digest(make(["x"]).where("false")).count() == 0


def test_the_gate_changes_no_answer(spark, small):
    model = L.trained()
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    more = [(10_000, "shared under CC-BY-SA 4.0"), (10_001, "Apache-2.0"), (10_002, "BSD-3-Clause"), (10_003, "is hereby  granted"), (10_004, "Attribution-ShareAlike 4.0 International"), (10_005, "x")]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r["doc_id"]: [(x["paragraph"], x["family"]) for x in r["found"]] for r in L.scan(docs).collect()}
    assert got == {r["doc_id"]: brute(r["text"], model) for r in docs.collect()}


@pytest.mark.parametrize("text,family", [
    ("licensed under CC BY-ND 4.0", "unknown"), ("Shared under the CC BY-NC-ND 4.0 license", "unknown"), ("The license plate of the red car was found near the MIT campus by the public.", "none"),
    ('Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute', "Boost"),
    ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "BSD"),
    ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", "WTFPL"), ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "Unlicense"),
    ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", "Zlib"),
    ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY", "GPL"),
])
def test_near_misses_and_paragraphs_of_texts(text, family):
    assert said(text, L.trained()) == family


def test_paragraphs_of_texts_with_words_lost():
    """Sentences of licence texts as training never has them: other words lost, other words around."""
    model, rng, right, wrong, n = L.trained(), np.random.default_rng(123), 0, 0, 0
    for name, (_, _, sentences) in L.FAMILIES.items():
        for s in sentences:
            for _ in range(8):
                w = [x for x in L.words(s) if rng.random() > 0.1]
                at = int(rng.integers(0, max(1, len(w) // 4)))
                got = said(" ".join(["xq", "zu", *w[at:], "vo"]), model)
                n, right, wrong = n + 1, right + (got == name), wrong + (got not in (name, L.UNKNOWN, L.NONE))
    assert right / n > 0.8 and wrong / n < 0.04, (right / n, wrong / n)
