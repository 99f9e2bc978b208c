import re
import time

import regex

from lodestream.llm import licenses as L

from .conftest import ODD_ROWS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = [(i, label) for phrase, label in L.BASE_PHRASES for n in [len(phrase.split())] for i in range(len(words) - n + 1) if words[i : i + n] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_matches_brute_force(documents, texts):
    of = {r.doc_id: r for r in L.scan_documents(documents).collect()}
    for key, text in texts:
        r = of[key]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text)
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


def test_odd_rows(odd, empty):
    got = sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in L.scan_documents(odd).collect())
    assert got == sorted(str((k, *base(t))) for k, t in ODD_ROWS)
    assert L.scan_documents(empty).collect() == []
    assert L.notice_spans(empty).collect() == []


def test_overlapping_base_phrases():
    n, hits = L.scanner().scan("cc by cc by CC-BY all rights reserved, all rights reserved")
    assert n == 12
    assert sorted((h.first_word, h.label) for h in hits if h.base) == [(0, "cc-by"), (2, "cc-by"), (4, "cc-by"), (6, "reserved"), (9, "reserved")]


def test_edits_are_bounded_and_reported():
    _, hits = L.scanner().scan("This code is licensed under teh apache licence version 2.0 today")
    found = {h.label: h for h in hits if not h.base}
    assert "apache-2.0" in found and 0 < found["apache-2.0"].edits <= 3
    _, hits = L.scanner().scan("an apricot lichen grew on the second version of the wall")
    assert hits == []


def test_seeds_miss_nothing():
    """Every notice with as many edits as it may have is found: against matching without seeds."""
    import random

    r = random.Random(4)
    for notice, label, k in L.NOTICES:
        for _ in range(5):
            letters = list(notice)
            for _ in range(r.randrange(k + 1)):
                letters[r.randrange(len(letters))] = r.choice("abcdefgh")
            text = "".join(letters)
            assert label in {h.label for h in L.scanner().scan(f"words before {text} words after")[1]}, (notice, text)


def spans_without_seeds(text):
    """(label, first word, words, edits) by verifying a window at every place of the text."""
    letters = f" {' '.join(WORD.findall(text.translate(LOWER)))} "
    spaces = [i for i, c in enumerate(letters) if c == " "]
    out = []
    for notice, label, k in L.NOTICES:
        pattern, found = regex.compile(f"(?b)(?: {notice} ){{e<={k}}}"), set()
        for at in range(len(letters)):
            window = letters[max(0, at - k) : at + len(notice) + 2 + k]
            if m := pattern.search(window):
                a = max(0, at - k) + m.start() + len(m.group()) - len(m.group().lstrip())
                b = max(0, at - k) + m.end() - len(m.group()) + len(m.group().rstrip())
                found.add((sum(m.fuzzy_counts), a, b))
        taken = []
        for edits, a, b in sorted(found):
            first, stop = sum(s < a for s in spaces) - 1, sum(s < b for s in spaces)
            if all(stop <= x or first >= y for x, y in taken):
                taken.append((first, stop))
                out.append((label, first, stop - first, edits))
    return sorted(out)


def test_spans_equal_matching_without_seeds():
    import random

    r = random.Random(9)
    for _ in range(25):
        parts = []
        for _ in range(3):
            letters = list(r.choice(L.NOTICES)[0])
            for _ in range(r.randrange(4)):
                letters[r.randrange(len(letters))] = r.choice("aeé r")
            parts += ["".join(letters), *["x filler"] * r.randrange(2)]
        text = " ".join(parts)
        assert sorted((h.label, h.first_word, h.n_words, h.edits) for h in L.scanner().scan(text)[1] if not h.base) == spans_without_seeds(text), text


def test_neighbouring_notices_are_all_reported():
    spans = lambda text, label: [(h.first_word, h.edits) for h in sorted(L.scanner().scan(text)[1], key=lambda h: h.first_word) if h.label == label and not h.base]
    assert spans("released under the mit licens released under the mit license", "mit") == [(0, 1), (5, 0)]
    assert (1, 2) in spans("gnu gnu generl public licnse gnu general public license x", "gpl")
    assert spans("all right reserved all rights reserved", "reserved") == [(0, 1), (3, 0)]
    assert spans("released under thé mit license", "mit") == [(0, 1)]


def test_time_is_linear_in_repeated_notices():
    text = "gnu generl public licnse, released under the mit licens; " * 36_000
    began = time.process_time()
    n, hits = L.scanner().scan(text)
    assert time.process_time() - began < 30
    assert n == 9 * 36_000 and sum(h.label == "mit" for h in hits) == 36_000 and sum(h.label == "gpl" for h in hits) >= 36_000


def test_spans_point_at_the_words(spark):
    df = spark.createDataFrame([(1, "x y Permission is hereby granted, free of charge, to any person obtaining a coppy of")], "doc_id long, text string")
    (row,) = L.notice_spans(df).collect()
    assert (row.label, row.base, row.first_word, row.n_words) == ("mit", False, 2, 13)
    assert row.matched.startswith("permission is hereby") and row.edits >= 1
