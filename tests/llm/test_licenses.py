import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelith.llm import licenses, queries


def test_notices_are_found_where_they_are(spark):
    mit = licenses.NOTICES["MIT"][2]
    words = mit.split()
    changed = " ".join(w if i % 12 else "İchanged" for i, w in enumerate(words))
    cut = " ".join(words[: len(words) // 2])
    rows = [
        (1, f"İ prose\n{mit}.\nmore"), (2, f"so {changed}"), (3, cut), (4, "Released  under\nthe MIT license!"), (5, "Licensed under the Foo License"),
        (6, "Licensed under CC BY-NC 4.0. and Licensed under the Apache License, Version 2.0."), (7, None), (8, ""), (9, "ab cd"), (4, "Released  under\nthe MIT license!"),
        (None, "SPDX-License-Identifier: MIT"), (10, "word " * 40000 + "Released under the MIT License" + " word" * 40000),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("License", F.lit("clash"))
    got = licenses.scan(df).collect()
    by = sorted((r["id"] or 0, r["license"]) for r in got)
    assert by == [(0, "MIT"), (1, "MIT"), (2, "MIT"), (4, "MIT"), (4, "MIT"), (6, "Apache-2.0"), (6, "CC-BY-NC-4.0"), (10, "MIT")]
    texts = dict(rows)
    for r in got:
        span = texts[r["id"]][r["start"] : r["end"]]
        assert licenses.words_of(span)[0] in ("permission", "released", "licensed", "spdx", "İchanged".lower(), "is")
        assert 0.85 <= r["coverage"] <= 1
    one = next(r for r in got if r["id"] == 1)
    assert texts[1][one["start"] : one["end"]] == mit and one["coverage"] == 1
    assert licenses.scan(df.limit(0)).count() == 0


def longest(template, words):
    row = [0] * (len(words) + 1)
    for x in template:
        last = 0
        for j, y in enumerate(words, 1):
            last, row[j] = row[j], max(row[j], row[j - 1], last + (x == y))
    return row[-1]


def test_alignment_in_a_wide_band_is_the_longest_common_subsequence():
    rng = random.Random(12)
    for _ in range(300):
        a, b = rng.choices("abc", k=rng.randrange(1, 9)), rng.choices("abcd", k=rng.randrange(1, 12))
        n, start, end = licenses.align(*(np.array([ord(c) for c in x]) for x in (a, b)), -20, 20)
        assert n == longest(a, b)
        if n:
            assert longest(a, b[start:end]) == n


def test_a_shared_run_has_a_fingerprint():
    index = licenses.Index(licenses.TEMPLATES)
    rng = random.Random(1)
    for number, words in enumerate(index.words):
        for at in range(len(words) - licenses.GRAM - licenses.WINDOW + 2):
            run = words[at : at + licenses.GRAM + licenses.WINDOW - 1]
            own = [f"z{rng.random()}" for _ in range(5)] + run + [f"z{rng.random()}" for _ in range(5)]
            numbers = np.array([index.known.get(w, 0) for w in own], np.uint64)
            assert any(t == number for _, t, _ in index.candidates(numbers))


def test_query_finds_every_planted_line(spark):
    """Lines of the table that read like notices, taken from the data: none is left out."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    told = re.compile(r"\b(licen[sc]ed? under|under the .* License|rights reserved|SPDX-License)", re.I)
    planted = {line.strip() for r in docs for line in (r["text"] or "").split("\n") if told.search(line)}
    sentences = {m for line in planted for m in re.findall(r"[^.]*?(?:icensed? under|eleased under|rights reserved)[^\n]*?\.(?= |$)", line)}
    assert len(sentences) >= 5
    want = {r["doc_id"] for r in docs if r["text"] and any(x in r["text"] for x in sentences)}
    got = queries.op6_licenses(spark, sf).collect()
    assert {r["doc_id"] for r in got} == want
    names = {"CC BY-NC 4.0": "CC-BY-NC-4.0", "GNU General Public License, version 3": "GPL-3.0", "Apache License, Version 2.0": "Apache-2.0", "MIT License": "MIT", "All rights reserved": "All-Rights-Reserved"}
    pairs = {(r["doc_id"], n) for r in docs for line, n in names.items() if r["text"] and line in r["text"]}
    assert pairs == {(r["doc_id"], r["license"]) for r in got}


def test_reserved_rights_are_found_wherever_they_stand(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("contains(text, 'All rights reserved.')").select("doc_id", "text")
    want = {r["doc_id"] for r in docs.collect()}
    got = licenses.scan(docs).where("license = 'All-Rights-Reserved'").collect()
    assert want and {r["id"] for r in got} == want


def test_adjacent_notices_are_all_found():
    index = licenses.Index(licenses.TEMPLATES)
    for notice, name in (("SPDX-License-Identifier: MIT", "MIT"), ("All rights reserved.", "All-Rights-Reserved"), (licenses.NOTICES["MIT"][2], "MIT"), (licenses.FULL["ISC"], "ISC")):
        for times in (1, 2, 3, 7):
            assert [x[0] for x in index.scan("\n".join([notice] * times), 0.85)] == [name] * times


def brute(index, text, coverage):
    """Alignments along every diagonal that shares a run of words, by a plain table; the same choice of what stays."""
    words = licenses.words_of(text)
    found = set()
    for t, own in enumerate(index.words):
        run = licenses.GRAM + licenses.WINDOW - 1 if len(own) >= licenses.SHORT else licenses.GRAM
        diagonals = {p - q for p in range(len(words) - run + 1) for q in range(len(own) - run + 1) if words[p : p + run] == own[q : q + run]}
        band = max(2, len(own) // 5)
        for d in diagonals:
            best = {}
            for i, w in enumerate(own):
                new, left = {}, (0, 0, 0)
                for k in range(d - band, d + band + 1):
                    j, here = i + k, max(left, best.get(k + 1, (0, 0, 0)))
                    if 0 <= j < len(words) and words[j] == w:
                        n, start, _ = best.get(k, (0, 0, 0))
                        here = max(here, (n + 1, start if n else j, -j))
                    new[k] = left = here
                best = new
            n, start, end = max(best.values())
            if n >= coverage * len(own):
                found.add((n, n / len(own), -start, 1 - end, t))
    out, taken = [], []
    for n, share, start, end, t in sorted(found, reverse=True):
        if all(end <= a or -start >= b for a, b in taken):
            taken.append((-start, end))
            out.append((index.names[t], share, n, -start, end))
    return sorted(out, key=lambda x: x[3])


def test_scans_are_brute_force():
    rng = random.Random(9)
    templates = {k: v for k, v in licenses.merged(licenses.NOTICES, licenses.RESERVED, {"ISC": [licenses.FULL["ISC"]]}).items() if k in ("MIT", "ISC", "BSD", "CC-BY-4.0", "CC-BY-NC-4.0", "All-Rights-Reserved", "Proprietary")}
    index = licenses.Index(templates)
    notices = [n for v in templates.values() for n in v]
    found = 0
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += [rng.choice(["of", "the", "software", "license", "a", "zebra"]) for _ in range(rng.randrange(6))]
            for w in licenses.words_of(rng.choice(notices)):
                x = rng.random()
                words += [] if x < 0.03 else [w, "zebra"] if x < 0.06 else ["zebra"] if x < 0.08 else [w]
        text = " ".join(words)
        spans = [m.span() for m in re.finditer(r"\w+", text)]
        want = [(name, share, n, spans[a][0], spans[b - 1][1]) for name, share, n, a, b in brute(index, text, 0.85)]
        assert index.scan(text, 0.85) == want
        found += len(want)
    assert found > 60


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no license files on this machine")
def test_whole_licenses_from_a_folder(spark):
    templates = licenses.read_templates("/usr/share/common-licenses")
    index = licenses.Index({"Apache-2.0": templates["Apache-2.0"], "GPL-2": templates["GPL-2"]})
    text = "before\n" + templates["Apache-2.0"][0].replace("TERMS", "Terms and") + "\nafter"
    (name, share, n, start, end), = index.scan(text, 0.85)
    assert name == "Apache-2.0" and share > 0.99 and start < 200 and end > len(text) - 200


def test_notices_of_more_licenses():
    index = licenses.Index(licenses.TEMPLATES)
    for name in ("GPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "EPL-2.0", "Proprietary", "BSD", "MPL-2.0", "ISC", "Zlib", "BSL-1.0", "BSD-3-Clause", "All-Rights-Reserved"):
        for notice in licenses.TEMPLATES[name]:
            assert [x[0] for x in index.scan(f"so it says\n{notice}.\nand more of it", 0.85)] == [name], notice
