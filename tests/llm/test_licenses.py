import re

from recallforge.llm import licenses, queries
from . import odd

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def base(rows):
    return [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows]


def test_base_places_match_brute_force(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = queries.op1_licenses(spark, data).collect()
    assert len(got) == len(texts)
    assert base(got) == [brute(texts[r.doc_id]) for r in got]
    assert sum(r.n_base for r in got) > 0
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (not r.labels or r.score >= licenses.LEAST)


def test_odd_rows(spark):
    got = licenses.scan(odd.frame(spark)).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(base(got), key=key) == sorted((brute(r[1]) for r in odd.ROWS), key=key)
    assert licenses.scan(odd.frame(spark, [])).count() == 0


def test_notices_with_changed_words(spark):
    texts = [
        "x Licensed under the Apache License, Version 2.0. y",
        "x Licensed under the terms Apache License, Version 2.0. y",
        "released under nothing, the license of the version",
        "All rights reserved all rights reserved. " * 50,
        "Released under the MIT License.\n" * 3,
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(5)] == ["apache-2.0", "apache-2.0", "", "reserved", "mit"]
    assert got[3].n_base == 100 and (got[3].first_word, got[3].last_word) == (0, 297)
    assert got[0].score == 1.0 and 0.8 <= got[1].score < 1


def test_spans_give_places(spark):
    docs = spark.createDataFrame([(1, "a b Released under the MIT License c")], "doc_id long, text string")
    got = licenses.spans(docs).where("label is not null").collect()
    assert [(r.label, r.start, r.end, r.similarity) for r in got] == [("mit", 2, 7, 1.0)]


def test_versions_tell_licenses_apart(spark):
    gpl, mpl = "x licensed under the GNU General Public License, version {} y", "x subject to the terms of the Mozilla Public License, v. {} y"
    texts = [gpl.format(2), gpl.format(3), mpl.format("1.1"), mpl.format("2.0"), "x Licensed under the Apache License, Version 2 y", "x Licensed under the Apache License, Version 1.1 y"]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(6)] == ["gpl,gpl-2.0", "gpl,gpl-3.0", "", "mpl-2.0", "apache-2.0", ""]


def brute_spans(text, known):
    """Verified spans of the templates that aren't base, straight from the definition of votes and diagonals."""
    own, out = licenses.words(text), []
    for t in known:
        if t.base:
            continue
        lines = {}
        for at in range(len(own) - t.k + 1):
            for tpos in range(len(t.words) - t.k + 1):
                if tuple(own[at : at + t.k]) == t.words[tpos : tpos + t.k]:
                    lines.setdefault(at - tpos, []).append((at, tpos))
        clusters, last = [], None
        for d in sorted(lines):
            if last is None or d - last > max(1, len(t.words) // 8):
                clusters.append([])
            clusters[-1] += lines[d]
            last = d
        for c in clusters:
            covered = {p + i for _, p in c for i in range(t.k)}
            start, end = min(a for a, _ in c), max(a for a, _ in c) + t.k
            similarity = len(covered) / max(len(t.words), end - start)
            if similarity >= licenses.LEAST and set(t.numbers) <= covered:
                out.append((t.label, start, end, round(similarity, 9)))
    return sorted(out)


def test_spans_match_brute_force(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    rows += [(10_000 + i, " ".join(t for t, _ in licenses.NOTICES[i:]) + " " + licenses.NOTICES[i][0].replace("the", "a the")) for i in range(len(licenses.NOTICES))]
    found = {}
    for r in licenses.spans(spark.createDataFrame(rows, "doc_id long, text string")).where("label is not null and not base").collect():
        found.setdefault(r.doc_id, []).append((r.label, r.start, r.end, round(r.similarity, 9)))
    known = licenses.templates()
    assert {d: sorted(f) for d, f in found.items()} == {d: b for d, t in rows if (b := brute_spans(t, known))}


def test_long_templates(spark):
    whole = " ".join(f"clause{i} of{i} the terms" for i in range(300))
    known = licenses.templates(licenses.PHRASES, [(whole, "long-1.0")])
    cut = whole.split()
    texts = ["a b " + whole + " c", " ".join(cut[:500] + ["new", "words"] + cut[500:]), " ".join(cut[:700])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.label, r.start, r.end) for r in licenses.spans(docs, known=known).where("label is not null").collect()}
    assert got == {0: ("long-1.0", 2, 1202), 1: ("long-1.0", 0, 1202)}
