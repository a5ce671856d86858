"""Each corpus operator on a small fixture against plain Python: nulls, empty and long texts, copies, ties, extra columns, empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import common, decontaminate, kneser_ney, licenses, ngram_join, quality_model, quality_rules, sentence_pieces, substring_dedup, token_files, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, places string, print int"
SPACE, ALNUM = "[^\x20\x09-\x0D]+", "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus():
    """Texts by id: copies, near copies, shared passages, blanks of all kinds, nulls, long and empty ones."""
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdeghilmnorstuéß") for _ in range(r.randint(1, 9))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared = text(70)
    base = text(220).split(" ")
    out = [None, "", " \n\t ", "one", "  Two  words　here ", "MIT License\nReleased under the MIT License.", "x " * 300, text(60) + "\n" + text(60)]
    out += [text(r.randint(5, 400)) for _ in range(20)]
    out += [text(40) + " " + shared + " " + text(r.randint(0, 50)) for _ in range(4)]
    for k in range(12):
        words = list(base)
        for _ in range(k // 2):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        out.append(" ".join(words))
    out += [out[10], out[10].upper(), " ".join(base), text(3000), "ab" * 5000, "▁x  <s> 😀 \x1c İ"]
    return dict(enumerate(out))


TEXTS = corpus()
NONE: dict = {}


def table(spark, texts):
    rows = [(i, t, ["en", None, "xx", "de"][i % 4], None, None, "clash", 3) for i, t in texts.items()]
    r = random.Random(1)
    r.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module", params=["full", "empty"])
def held(request, spark):
    texts = TEXTS if request.param == "full" else NONE
    return table(spark, texts), texts


def by_id(df):
    return {x.doc_id: x for x in df.collect()}


def test_words_hash_equal_words_alike(spark):
    texts = ["a b a", "", "ab", "b"]
    import pyarrow as pa

    w = common.words_of(*common.raw(pa.array(texts, pa.large_string())), common.SPACED)
    h = w.hashes()
    assert w.counts().tolist() == [3, 0, 1, 1] and h[0] == h[2] and h[1] == h[4] and len(set(h.tolist())) == 3


def thue_morse(n, a="a", b="b"):
    """Sequences that polynomials modulo a power of two can't tell apart."""
    one, two = [a], [b]
    while len(one) < n:
        one, two = one + two, two + one
    return one, two


def test_words_and_windows_of_thue_morse_differ(spark):
    import pyarrow as pa

    for n in (2, 16, 32, 64, 1024):
        pair = ["".join(x) for x in thue_morse(n)]
        one, two = common.words_of(*common.raw(pa.array(pair, pa.large_string())), common.SPACED).hashes()
        assert one != two
    a, b = "".join(thue_morse(1024)[0]), "".join(thue_morse(1024)[1])
    rest = [f"w{k}" for k in range(29)]
    docs = spark.createDataFrame([(1, " ".join([a, *rest])), (2, " ".join([b, *rest]))], "doc_id long, text string")
    gone = by_id(substring_dedup.deduplicate(docs, 30, digests=True))
    assert [gone[i].n_removed for i in (1, 2)] == [0, 0]
    words = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert {x.component_id for x in ngram_join.link(words).collect()} == {1, 2}
    one, two = (substring_dedup.window_hashes(np.array([{"a": 5, "b": 9}[x] for x in y], np.uint64), 32) for y in thue_morse(32))
    assert one[0] != two[0]


def test_word_hashes_of_all_lengths():
    import pyarrow as pa

    r = random.Random(2)
    texts = sorted({"".join(r.choice("ab\0é") for _ in range(n)) for n in range(1, 140) for _ in range(20)})
    h = common.words_of(*common.raw(pa.array(texts, pa.large_string())), common.SPACED).hashes()
    again = common.words_of(*common.raw(pa.array(["x y"] + texts[::-1], pa.large_string())), common.SPACED).hashes()[2:][::-1]
    assert len(set(h.tolist())) == len(texts) and (h == again).all()
    a = np.array([0, 1, 2**61 - 2, 2**60, 12345], np.uint64)
    assert [[int(x) for x in common.times(a, y)] for y in a] == [[int(x) * int(y) % common.PRIME for x in a] for y in a]


def test_op1(held):
    docs, texts = held
    got = by_id(licenses.scan(docs))
    assert set(got) == set(texts)
    for i, t in texts.items():
        w = re.findall(ALNUM, lower(t))
        places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == (len(w), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted({x for _, x in places})))


def forms_of(markup):
    """Plain texts of a template: everything optional in it, then left out; each choice; the longest and the shortest of what may differ."""
    out = []
    for whole in (True, False):
        for turn in range(3):
            words, skipping = [], 0
            for token in licenses.plain(markup):
                if token in ("<<optional>>", "<<end>>"):
                    skipping += {"<<optional>>": 1, "<<end>>": -1}[token] if not whole else 0
                elif skipping:
                    continue
                elif token.startswith("<<one of"):
                    held = licenses.choices(token)
                    words += held[turn % len(held)]
                elif token.startswith("<<any"):
                    words += [f"zz{k}" for k in range(int(token[6:-2]) if whole else min(1, int(token[6:-2])))]
                else:
                    words.append(token)
            out.append(" ".join(words))
    return out


def test_op1_templates_accept_their_own_texts_only(spark):
    texts = [(label, form) for label, markup in licenses.TEMPLATES.items() for form in forms_of(markup)]
    got = by_id(licenses.scan(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string").repartition(4)))
    for k, (label, text) in enumerate(texts):
        found = {x for x in got[k].labels.split(",") if x} - set(licenses.PHRASES.values())
        assert found == {label}, (label, text, found)


def test_op1_notices_as_published(spark):
    program = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {}General Public License for more details."
    texts = {
        program.format("", ""): "gpl,gpl-notice", program.format("Affero ", "Affero "): "agpl-notice", program.format("Lesser ", "Lesser ").replace("program", "library").replace("software:", "software;"): "lgpl-notice",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa-notice", "This work is licensed under the Creative Commons Attribution 4.0 International License": "cc-by-notice",
        "licensed under CC BY-NC-SA 4.0": "cc-by,cc-by-nc-sa-4.0", "Licensed under the GNU General Public License v3.0": "gpl,gpl-3.0", "Copyright 2019 The Authors of a Very Long Named Example Project. All rights reserved": "copyright-reserved",
    }
    got = by_id(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert {t: got[k].labels for k, t in enumerate(texts)} == texts


def test_op7_repeated_and_null_item_ids(spark):
    docs = spark.createDataFrame([(1, "x one two three y four five"), (2, "none")], "doc_id long, text string")
    bench = spark.createDataFrame([("i1", "one two three"), ("i1", "one two three"), ("i1", "four five"), ("i2", "four five"), (None, "one two three")], "item_id string, text string")
    for limit in (decontaminate.BLOCK_WORDS, 1):
        old, decontaminate.BLOCK_WORDS = decontaminate.BLOCK_WORDS, limit
        try:
            got = by_id(decontaminate.report(docs, bench, 3))
        finally:
            decontaminate.BLOCK_WORDS = old
        assert (got[1].n_hit, got[1].n_items, got[1].items_sha256, got[2].n_items) == (5, 2, hashlib.sha256(b"i1,i2").hexdigest(), 0)
    nameless = by_id(decontaminate.report(docs, bench.filter("item_id IS NULL"), 3))
    assert (nameless[1].n_hit, nameless[1].n_items, nameless[1].contaminated) == (3, 0, True)


def test_op8_repeated_labelled_rows_count_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c")] * 500 + [(2, "Some words, " * k) for k in range(300)] + [(3, "d e f")], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_model, "fit", lambda x, y: seen.append((x.shape[0], int(y.sum()))))
    quality_model.train(docs, labels, folds=10**6)
    quality_model.train(docs, labels, folds=10**6, sample=20)
    assert seen[0][0] <= 302 and seen[0][1] == 2 and seen[1][0] == 20


def test_units_of_one_hash_are_told_apart(monkeypatch, tmp_path):
    """With hashes that are all but useless the table still gives each unit its own values."""
    from ledgerlens.llm import unit_table

    monkeypatch.setattr(common.Words, "hashes", lambda self: ((self.end - self.start) % 3).astype(np.uint64) << np.uint64(62))
    import pyarrow as pa
    import sentencepiece

    texts = ["one two three twelve letters onetwothreefour onetwothreefive", "two six ten one", "x" * 40 + " " + "x" * 39 + "y"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    segmenter = sentence_pieces.units_for(PIECES) if hasattr(sentence_pieces, "units_for") else token_files.units_for(WORDS)
    sent = list(unit_table._send(lambda: segmenter, 3, 5, iter([batch])))
    rows = [x for b in unit_table._save(lambda: segmenter, f"file://{tmp_path}", iter(sent)) for x in b.to_pylist()]
    names = [""] * 3
    for x in rows:
        names[x["bucket"]] = x["name"]
    table = unit_table.UnitTable(f"file://{tmp_path}", names, segmenter.kind)
    units = segmenter.units(*common.raw(pa.array(texts, pa.large_string())))
    codes, many, begin, values = table.values(segmenter, units)
    whole = [units.data[a:b].tobytes().decode() for a, b in zip(units.start, units.end, strict=True)]
    want_many, want = segmenter.segment(whole)
    assert many[codes].tolist() == want_many.tolist()
    got = np.concatenate([values[begin[c] : begin[c] + many[c]] for c in codes])
    assert got.tolist() == want.tolist()
    assert sentencepiece is not None
    one, two = np.frombuffer(b"abcdefgh1abcdefgh2abcdefgh1ab", np.uint8), np.array([0, 9, 18, 27, 0])
    assert unit_table.same_bytes(one, two, np.array([9, 9, 9, 2, 0]), one, np.zeros(5, np.int64), np.array([9, 9, 9, 2, 0])).tolist() == [True, False, True, True, True]


def test_op10_windows_of_one_hash(spark):
    """Texts in which hashes can't tell windows apart are judged by the windows themselves."""
    from ledgerlens.llm.quality_rules import _CLASH, _repeated_words

    words = "a b c d a b c e".split()
    packed = [5 << 16 | k for k in range(6)]
    df = spark.createDataFrame([(words, packed, 8)], "words array<string>, packed array<long>, n_words long")
    assert df.select(F.expr(_CLASH)).first()[0] is True
    windows = sorted((words[k : k + 3], k) for k in range(6))
    row = spark.createDataFrame([(words, None, windows, 8)], "words array<string>, packed array<long>, windows array<struct<w:array<string>,p:long>>, n_words long")
    assert row.select(_repeated_words()).first()[0] == 6


def variants(markup):
    """All plain forms of a small template: words, and None for any word; with the number of mandatory words up to each place."""
    out, stack = [([], [])], []
    depth, kept = 0, []
    for token in licenses.plain(markup):
        if token == "<<optional>>":
            depth += 1
            kept.append(list(out))
        elif token == "<<end>>":
            depth -= 1
            out += kept.pop()
        elif token.startswith("<<any"):
            out = [(w + [None] * k, m + [False] * k) for w, m in out for k in range(int(token[6:-2]) + 1)]
        else:
            out = [(w + [token], m + [not depth]) for w, m in out]
    return out + stack


def best_share(words, markup):
    """(accepted places, largest share of mandatory words in place) by trying every form at every place where the leading words stand."""
    tokens = licenses.plain(markup)
    lead = next((k for k, t in enumerate(tokens) if t.startswith("<<")), len(tokens))
    lead = tokens[: min(lead, 2)]
    forms = variants(markup)
    total, share, places = max(1, sum(forms[0][1])), 0.0, []
    for at in range(len(words)):
        if words[at : at + len(lead)] != lead:
            continue
        for form, needed in forms:
            n = 0
            for k, (w, m) in enumerate(zip(form, needed, strict=True)):
                if at + k >= len(words) or (w is not None and words[at + k] != w):
                    break
                n += m
            else:
                places.append(at)
                n = total
            share = max(share, n / total)
    return sorted(set(places)), share


SMALL = {
    "one": "alpha beta <<optional>> gamma <<optional>> delta <<end>> <<end>> epsilon <<any 2>> zeta",
    "two": "alpha <<any 1>> beta gamma",
    "three": "<<optional>> delta <<end>> beta beta",
    "four": "Alpha; Beta-gamma <<optional>> (alpha) <<end>>",
}


def test_op1_labels_scores_and_matches_equal_brute_force(spark):
    r = random.Random(4)
    texts = {i: " ".join(r.choice(["alpha", "Beta", "gamma", "delta", "epsilon", "zeta", "x", "MIT License", "cc by"]) for _ in range(r.randint(0, 25))) for i in range(400)}
    got = by_id(licenses.scan(table(spark, texts), SMALL))
    for i, t in texts.items():
        w = re.findall(ALNUM, lower(t))
        found = {label: best_share(w, markup) for label, markup in SMALL.items()}
        base = set(filter(None, got[i].base_labels.split(",")))
        assert got[i].labels == ",".join(sorted(base | {k for k, (places, _) in found.items() if places})), t
        assert math.isclose(got[i].score, max([0.5 if base else 0.0, *(s for _, s in found.values())])), t
        assert sorted((x.label, x.word) for x in got[i].matches) == sorted((k, p) for k, (places, _) in found.items() for p in places)


def test_op1_templates_by_scan(spark):
    """Ordinary wordings inside texts: what stands in the optional and free places must not hide them."""
    texts = {label: "Before it. " + re.sub(r"<<one of: ([^|>]*)[^>]*>>", r"\1", re.sub(r"<<any \d+>>", "Some", re.sub("<<optional>>|<<end>>", " ", markup))) + " and after" for label, markup in licenses.TEMPLATES.items()}
    texts |= {"notice": "Copyright 2024 Some Company. All rights reserved.", "far": f"copyright {' '.join('abcdefghijklmnopq')} all rights reserved", "twice": "copyright copyright x all rights reserved"}
    got = by_id(licenses.scan(spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id string, text string")))
    places = lambda k: [(x.label, x.word) for x in got[k].matches]
    assert all((label, 2) in places(label) and label in got[label].labels.split(",") and got[label].score == 1 for label in licenses.TEMPLATES)
    assert places("notice") == [("copyright-reserved", 0)] and got["notice"].labels == "copyright-reserved"
    assert places("far") == [] and got["far"].score == 0.25
    assert places("twice") == [("copyright-reserved", 0), ("copyright-reserved", 1)]
    first = licenses.scan(spark.createDataFrame([(1, "x b c")], "doc_id long, text string"), {"t": "<<optional>> a <<end>> b c"}).first()
    assert [(x.label, x.word) for x in first.matches] == [("t", 1)]


def test_op2(held):
    import sentencepiece

    docs, texts = held
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got, full = by_id(sentence_pieces.encode(docs, PIECES, digests=True)), by_id(sentence_pieces.encode(docs, PIECES, looked_up=100, sent=50))
    back = by_id(sentence_pieces.decode(sentence_pieces.encode(docs, PIECES).drop("decoded"), PIECES))
    for i, t in texts.items():
        ids = model.encode(t or "")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), model.decode(ids))]
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), *sha)
        assert full[i].ids == ids and full[i].decoded == back[i].decoded == model.decode(ids)


class PlainModel:
    """Interpolated modified Kneser-Ney by dictionaries; counts of the highest order are of tokens, those below of distinct words before."""

    def __init__(self, texts, order):
        self.order = order
        padded = [["<begin>"] * (order - 1) + t for t in texts]
        grams = collections.Counter(tuple(t[k : k + order]) for t in padded for k in range(len(t) - order + 1))
        self.counts = {order: grams}
        for k in range(order - 1, 0, -1):
            self.counts[k] = collections.Counter(g[1:] for g in self.counts[k + 1])
        self.d = {k: kneser_ney.discounts(*(collections.Counter(c.values())[x] for x in range(1, 5))) for k, c in self.counts.items()}
        self.total, self.left = collections.Counter(), collections.Counter()
        for k, counts in self.counts.items():
            for g, c in counts.items():
                self.total[k, g[:-1]] += c
                self.left[k, g[:-1]] += self.d[k][min(c, 3)]
        self.types = len({w for t in texts for w in t})

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / (self.types + 1)
        total = self.total[k, gram[:-1]]
        if not total:
            return self.p(gram[1:])
        c = self.counts[k][gram]
        return (max(c - self.d[k][min(c, 3)], 0) + self.left[k, gram[:-1]] * self.p(gram[1:])) / total


@pytest.mark.parametrize(("order", "limits"), [(3, {}), (3, {"gathered": 300, "passes": 3}), (2, {})])
def test_op3(held, order, limits):
    docs, texts = held
    got = by_id(kneser_ney.train_and_score(docs, order=order, **limits))
    assert set(got) == set(texts)
    tokens = {i: [*re.findall(SPACE, lower(t)), "<end>"] for i, t in texts.items()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    training = [t for i, t in tokens.items() if not out[i]]
    single, model = collections.Counter(w for t in training for w in t), PlainModel(training, order)
    n, v = sum(single.values()), len(single)
    for i, t in tokens.items():
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (out[i], len(t), sum(single[w] > 0 for w in t), n)
        assert math.isclose(x.base_score, sum(math.log10((single[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        padded = ["<begin>"] * (order - 1) + t
        assert math.isclose(x.score, sum(math.log10(model.p(tuple(padded[k : k + order]))) for k in range(len(t))), rel_tol=1e-9)


def test_op3_counts_beyond_a_byte_and_probabilities_sum_to_one(spark):
    """Words, pairs and trigrams that occur 255 times and more; over all words and one unknown a context's probabilities sum to one."""
    texts = ["a b c " * 300, "a b d", "a c b", *["a b c"] * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = common.new_folder(spark, "many")
    model = kneser_ney.train(docs, folder, 3, passes=2)
    plain = PlainModel([[*t.split(), "<end>"] for t in texts], 3)
    ask = [f"{c} {w}".strip() for c in ("a b", "b c", "c", "", "zz a", "a zz") for w in ("a", "b", "c", "d", "unknown")]
    got = {x.doc_id: x.score for x in kneser_ney.score(spark.createDataFrame(list(enumerate(ask)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(ask):
        padded = ["<begin>", "<begin>", *t.split(), "<end>"]
        assert math.isclose(got[i], sum(math.log10(plain.p(tuple(padded[k : k + 3]))) for k in range(len(padded) - 2)), rel_tol=1e-9), t
    for context in (("a", "b"), ("b", "c"), ("q", "a"), ("<begin>", "<begin>")):
        assert math.isclose(sum(plain.p((*context, w)) for w in ("a", "b", "c", "d", "<end>", "unknown")), 1)


def windows_gone(texts, width):
    words, first = {i: re.findall(SPACE, t or "") for i, t in texts.items()}, {}
    for i, w in sorted(words.items()):
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    gone = {i: [False] * len(w) for i, w in words.items()}
    for i, w in words.items():
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[i][k : k + width] = [True] * width
    return words, gone


@pytest.mark.parametrize("gathered", [1_500_000, 500])
def test_op4(held, gathered):
    docs, texts = held
    got = by_id(substring_dedup.deduplicate(docs, 50, digests=True, gathered=gathered))
    words, gone = windows_gone(texts, 50)
    for i in texts:
        kept = " ".join(w for w, g in zip(words[i], gone[i], strict=True) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(words[i]), sum(gone[i]), hashlib.sha256(kept.encode()).hexdigest())
    whole = by_id(substring_dedup.deduplicate(docs, 50))
    assert all((whole[i].text or "") == (texts[i] or "") for i in texts if not any(gone[i])) and (not texts or len(whole[0]) == 7)


def test_op4_null_ids_stay(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "a b c d x")], "doc_id long, text string")
    assert sorted((x.doc_id or 0, x.n_removed) for x in substring_dedup.deduplicate(docs, 3, digests=True).collect()) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 4)]


def sets_of(texts, width):
    out = {}
    for i, t in texts.items():
        w = re.findall(SPACE, lower(t))
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    return out


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_op5(held, width, percent):
    docs, texts = held
    got, sets = by_id(ngram_join.link(docs, width, percent)), sets_of(texts, width)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == {i: (len(s), find(i)) for i, s in sets.items()}
    assert set(by_id(ngram_join.keep_one(docs, width, percent))) == {i for i in sets if find(i) == i}


def test_op5_one_value_of_many_sets(spark):
    """Chains in one crowded group, in small chunks: each text is near its neighbours only."""
    words = [f"w{i}" for i in range(120)]
    texts = {}
    for k in range(30):
        words = words[: 4 * k] + [f"new{k}"] + words[4 * k + 1 :] if k else words
        texts[k] = " ".join(words)
    got = by_id(ngram_join.link(table(spark, texts), 1, 90, crowd=4, chunk=5, gathered=60, heavy=3))
    assert {x.component_id for x in got.values()} == {0}


def test_op5_a_centre_of_many_pairs(spark):
    """A star of near copies, whose centre's pairs are dealt over tasks."""
    words = [f"w{i}" for i in range(100)]
    texts = {k: " ".join(words[:k] + [f"own{k}"] + words[k + 1 :]) if k else " ".join(words) for k in range(60)}
    got = by_id(ngram_join.link(table(spark, texts), 1, 95, heavy=7))
    assert {x.component_id for x in got.values()} == {0} and all(x.n_links > 0 for x in got.values())


def test_op6(held, tmp_path):
    from tokenizers import Tokenizer

    docs, texts = held
    got, library, start = by_id(token_files.round_trip(docs, WORDS, 1, looked_up=200, sent=100, file_bytes=3000)), Tokenizer.from_file(WORDS), 0
    assert set(got) == set(texts)
    for i in sorted(texts):
        ids = np.array([*library.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def odd_texts(n):
    """Random strings of the signs that tokenizers treat in some way of their own."""
    r = random.Random(8)
    signs = [*"abcdefgzABCZ éÉßİıΣςªº×÷\x1c\x1f\x85\xa0\u3000\u2028\u0301\u0345▁▁  \n\t\x00", "'s", "'LL", "<s>", "<|endoftext|>", "<|ENDOFTEXT|>", "😀", "안", "ｆｕ", "123", "...", "!!!!!!!!!!!!", "-", ")", "|", "K", "the ", "and "]
    return {i: "".join(r.choice(signs) for _ in range(r.randint(0, 40))) for i in range(n)}


def test_op2_and_op6_on_odd_texts(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    texts = odd_texts(1500)
    docs = table(spark, texts)
    model, library = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(WORDS)
    pieces = by_id(sentence_pieces.encode(docs, PIECES))
    digests = by_id(sentence_pieces.encode(docs, PIECES, digests=True, looked_up=1000))
    words = by_id(token_files.round_trip(docs, WORDS, 1))
    for i, t in texts.items():
        ids = model.encode(t)
        assert (pieces[i].ids, pieces[i].decoded, pieces[i].n_tokens) == (ids, model.decode(ids), len(ids)), t
        assert (digests[i].ids_sha256, digests[i].decoded_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), model.decode(ids)))
        assert words[i].ids_crc32 == zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()), t


def test_op6_null_and_repeated_ids(spark):
    rows = [(None, "one two"), (5, "a"), (5, "b c"), (5, "d"), (None, None), (7, "e f g"), (-3, "h")] + [(5, "x y")] * 40
    got = token_files.round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), WORDS, 1).collect()
    got.sort(key=lambda x: x.start)
    assert [x.doc_id for x in got] == [None] * 2 + [-3] + [5] * 43 + [7]
    assert [x.start for x in got] == [sum(y.n_tokens for y in got[:k]) for k in range(len(got))]


def test_op6_coding():
    values = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7], np.uint32)
    for n in range(len(values) + 1):
        control, data = token_files.pack(values[:n])
        assert token_files.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n).tolist() == values[:n].tolist()


def test_op7(held, spark):
    docs, texts = held
    long_one = [t for t in texts.values() if t and 300 < len(t) < 3000] or ["nothing here"]
    items = {3: " ".join(long_one[0].split()[4:19]), 21: "Two words", 100: None, 7: "", 8: "two WORDS", 9: " ".join(f"q{k}" for k in range(12))}
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    phrases = collections.defaultdict(set)
    for i, t in items.items():
        w = re.findall(ALNUM, lower(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            phrases[tuple(w[k : k + 10])].add(str(i))
    got, cut = by_id(decontaminate.report(docs, benchmark)), by_id(decontaminate.remove(docs, benchmark))
    for i, t in texts.items():
        w, hit, found = re.findall(ALNUM, lower(t)), set(), set()
        for p, owners in phrases.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found |= owners
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256) == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
        assert len(re.findall(ALNUM, lower(cut[i].text))) == len(w) - len(hit)
    none = by_id(decontaminate.report(docs, benchmark.limit(0)))
    assert not any(x.contaminated for x in none.values())


def test_op7_blocks_change_nothing(spark, monkeypatch):
    """Items that overlap, meet across a cut or share an id, and rows that share one, in one block and in many."""
    texts = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (None, "p q x y z r s"), (2, None), (2, "A b, C."), (3, "")]
    items = [(1, "b c d e"), (2, "d e f g"), (3, "x y z"), (4, "q r s"), (5, "a b c"), (5, "b c d"), (6, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda df: sorted(map(repr, df.collect()))
    got = []
    for words in (decontaminate.BLOCK_WORDS, 4, 0):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", words)
        got.append([rows(f(docs, benchmark, 3)) for f in (decontaminate.report, decontaminate.spans, decontaminate.remove)])
    assert got[0] == got[1] == got[2]
    report, cut = decontaminate.report(docs, benchmark, 3), decontaminate.remove(docs, benchmark, 3)
    assert sorted((x.doc_id or 0, x.n_words, x.n_hit, x.n_items) for x in report.collect()) == [(0, 7, 3, 1), (1, 8, 7, 3), (1, 8, 7, 3), (2, 0, 0, 0), (2, 3, 3, 1), (3, 0, 0, 0)]  # both rows of 5 are one item
    assert sorted(x.text for x in cut.collect()) == ["", "", " h", " h", ".", "p q  r s"]


def test_op7_index_equals_brute_force():
    r = np.random.default_rng(4)
    for n, top in ((1, 3), (50, 2), (400, 3), (3000, 40)):
        text = np.append(r.integers(1, top + 1, n), 0)
        index = decontaminate.FMIndex(text, top)
        assert [text[k:].tolist() for k in decontaminate.suffix_order(text, top)] == sorted(text[k:].tolist() for k in range(len(text)))
        symbols = r.integers(1, top + 1, (20, 3)).astype(np.int32)
        low, high = index.search(symbols, np.full(20, 3))
        for s, a, b in zip(symbols, low, high, strict=True):
            places = sorted(index.locate(np.arange(a, max(a, b))).tolist())
            assert places == [k for k in range(n - 2) if text[k : k + 3].tolist() == s.tolist()]


def test_op8(spark):
    r = random.Random(6)
    rows, marks = [], []
    for i in range(600):
        good = i % 3 > 0
        w = ["".join(r.choice("aeiounrst") for _ in range(r.randint(2, 8))) for _ in range(r.randint(20, 120))]
        rows.append((i, " ".join(x if good else x.upper() + "!!" for x in w) + "."))
        marks.append((i, int(good), 0))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, "z" * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (5000, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = by_id(quality_model.score(docs, quality_model.train(docs, labels)))
    test = [(got[i].predicted, q) for i, q, _ in marks if got[i].held_out]
    assert len(got) == 603 and len(test) > 80 and sum(p == q for p, q in test) / len(test) > 0.97
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) and x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, x in got.items())
    flat = quality_model.train(docs, labels.limit(0))
    assert {x.score for x in quality_model.score(docs, flat).collect()} == {0.5}
    assert quality_model.score(docs.limit(0), flat).count() == 0


def plain_features(t):
    w, lines = re.findall(SPACE, t), [x.encode() for x in t.split("\n") if x]
    size = [len(x.encode()) for x in w]
    n, solid, n_lines = max(len(w), 1), max(sum(size), 1), max(len(lines), 1)
    held = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "symbol": b"#*$%&|<>@^~_=+{}[]\\/", "stop": b".,;:!?'\"()-", "mark": b"!?", "beyond": range(128, 256)}
    windows = len({tuple(w[k : k + 3]) for k in range(len(w) - 2)}) if len(w) > 2 else min(len(w), 1)
    return [
        math.log1p(len(w)), solid / n, math.log1p(max(size, default=0)), *(sum(b in x for b in t.encode()) / solid for x in held.values()), len(set(w)) / n, windows / max(len(w) - 2, 1), len(set(lines)) / n_lines,
        math.log1p(len(w) / n_lines), sum(x <= 3 for x in size) / n, max(collections.Counter(w).values(), default=0) / n, sum(x[-1] not in b".!?:" for x in lines) / n_lines,
        sum(x.encode()[-1] in held["symbol"] or x.encode()[-1] in held["mark"] for x in w) / n,
    ]


def test_op8_features_equal_plain_python():
    import pyarrow as pa

    texts = [t or "" for t in TEXTS.values()] + ["#a! b\nb\n\nC? 1.", "x"]
    got = quality_model.features(*common.raw(pa.array(texts, pa.large_string())))
    assert np.allclose(got, [plain_features(t) for t in texts]) and got.shape[1] == len(quality_model.NAMES)


def plain_tree(g, h, leaves):
    parts = [(0, len(g))]
    worth = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + 1)
    while len(parts) < leaves:
        cuts = [(worth(a, c) + worth(c, b) - worth(a, b), a, c, b) for a, b in parts for c in range(a + 1, b)]
        if not cuts or max(cuts)[0] <= 1e-9:
            break
        _, a, c, b = max(cuts)
        parts = [x for x in parts if x != (a, b)] + [(a, c), (c, b)]
    return {k: sum(g[a:b]) / (sum(h[a:b]) + 1) for a, b in parts for k in range(a, b)}


def test_op8_tables_and_scores_equal_brute_force(monkeypatch):
    """Cyclic boosting by loops over rows, and scores by sums of table values."""
    for name, value in (("ROUNDS", 3), ("PAIR_ROUNDS", 2), ("PAIRS", 2), ("BINS", 6), ("PAIR_BINS", 3)):
        monkeypatch.setattr(quality_model, name, value)
    r = np.random.default_rng(3)
    width = len(quality_model.NAMES)
    x = r.normal(size=(90, width))
    y = (x[:, 1] + x[:, 2] * x[:, 4] + 0.3 * r.normal(size=90) > 0).astype(float)
    model = quality_model.fit(x, y)
    share = (y.sum() + 0.5) / (len(y) + 1)
    total = [math.log(share / (1 - share))] * len(y)
    place = lambda edges, v: sum(e <= v for e in edges)
    tables = [[0.0] * (len(e) + 1) for e in model.edges]

    def sums(cells, n):
        g, h = [0.0] * n, [0.0] * n
        for i, c in enumerate(cells):
            p = 1 / (1 + math.exp(-total[i]))
            g[c] += y[i] - p
            h[c] += p * (1 - p)
        return g, h

    for _ in range(3):
        for k, table in enumerate(tables):
            bins = [place(model.edges[k], v) for v in x[:, k]]
            step = plain_tree(*sums(bins, len(table)), quality_model.LEAVES)
            for b in range(len(table)):
                table[b] += quality_model.STEP * step[b]
            total = [t + quality_model.STEP * step[b] for t, b in zip(total, bins, strict=True)]
    assert all(np.allclose(a, b) for a, b in zip(tables, model.tables, strict=True))
    coarse = [[place(e, v) for v in x[:, k]] for k, e in enumerate(model.pair_edges)]

    def quadrants(a, b):
        rows, columns = len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1
        g, h = sums([i * columns + j for i, j in zip(coarse[a], coarse[b], strict=True)], rows * columns)
        best = (0.0, {})
        for r_, c_ in [(i, j) for i in range(1, rows) for j in range(1, columns)]:
            cells = collections.defaultdict(list)
            for i in range(rows):
                for j in range(columns):
                    cells[i >= r_, j >= c_].append((i, j))
            part = {q: (sum(g[i * columns + j] for i, j in v), sum(h[i * columns + j] for i, j in v)) for q, v in cells.items()}
            gain = sum(a_ * a_ / (b_ + 1) for a_, b_ in part.values())
            if gain > best[0]:
                best = (gain, {ij: part[q][0] / (part[q][1] + 1) for q, v in cells.items() for ij in v})
        return best

    ranked = sorted(((quadrants(a, b)[0], a, b) for a in range(width) for b in range(a)), reverse=True)[:2]
    assert model.pairs == [(a, b) for _, a, b in ranked]
    pairs = [collections.Counter() for _ in model.pairs]
    for _ in range(2):
        for (a, b), table in zip(model.pairs, pairs, strict=True):
            step = quadrants(a, b)[1]
            for ij, v in step.items():
                table[ij] += quality_model.STEP * v
            total = [t + quality_model.STEP * step[i, j] for t, i, j in zip(total, coarse[a], coarse[b], strict=True)]
    assert all(np.allclose(held[i, j], table[i, j]) for held, table in zip(model.pair_tables, pairs, strict=True) for i, j in table)
    assert np.allclose(model.score(x), [1 / (1 + math.exp(-t)) for t in total])


def test_op9(spark):
    x = "ä" * 80
    rows = [(3, "http://WWW.a.org:80/p?q=1#f", x), (1, "https://a.org/x y", x), (2, None, x), (9, "http://b.org", "short"), (8, "http://b.org", "short"), (7, "u", None), (-4, "http://c.org/%", "y" * 99)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, key string")
    got = {r.page_id: tuple(r)[1:] for r in warc.round_trip(pages).collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert got == {i: (len((t or "").encode()), sha(t), "revisit" if i in (2, 3) else "response", 1 if i in (2, 3) else None) for i, _, t in rows}
    assert warc.round_trip(pages.limit(0)).count() == 0
    folder = common.new_folder(spark, "look")
    index = index_of(warc.write(pages, folder), folder)
    key = pages.filter("page_id = 3").select(warc.surt(F.col("url"))).first()[0]
    assert key == "org,a,www)/p?q=1" and [f["WARC-Type"] for f, _, _ in index.captures(key)] == ["revisit"]
    assert sorted(p for _, _, p in index.captures("org,b)/")) == [b"short", b"short"] and list(index.captures("zz")) == []


def index_of(archives, folder):
    return warc.CaptureIndex([tuple(x) for x in archives.select("first_key", "last_key", "archive", "index", "directory").collect()], folder)


def test_op9_keys_of_every_order(spark):
    """Blocks of two captures and small archives: keys with blanks, signs below and above them, line ends, and one key over several blocks."""
    urls = ["http://a.org/x y", "http://a.org/x!y", "http://a.org/x%20y", "http://a.org/x", "http://a.org/x\ny", "http://a.org/é", "", None, *["http://hot.org"] * 9]
    pages = spark.createDataFrame([(i, u, f"page {i} " * 20) for i, u in enumerate(urls)], "page_id long, url string, html string")
    folder = common.new_folder(spark, "order")
    archives = warc.write(pages, folder, block_lines=2, archive_bytes=600)
    index, keys = index_of(archives, folder), {x.page_id: x.key for x in pages.select("page_id", warc.surt(F.col("url")).alias("key")).collect()}
    assert archives.count() > 3
    for key in set(keys.values()):
        assert sorted(p.decode() for _, _, p in index.captures(key)) == sorted(f"page {i} " * 20 for i in keys if keys[i] == key)
    assert all(not list(index.captures(k)) for k in ("", "a", "org,a)/x z", "zzz"))
    some = spark.createDataFrame([("org,a)/x y",), ("org,hot)/",), ("org,hot)/",), ("no",), (None,)], "key string")
    assert sorted(x.page_id for x in warc.look_up(some, archives, folder).collect()) == [0, *range(8, 17)]


def repeats(words):
    seen = collections.defaultdict(list)
    for k in range(len(words) - 2):
        seen[tuple(words[k : k + 3])].append(k)
    return len({j for v in seen.values() if len(v) > 1 for k in v for j in range(k, k + 3)})


def js_distance(p, q):
    half = lambda x, y: sum(a * math.log2(2 * a / (a + b)) for a, b in zip(x, y, strict=True) if a > 0)
    return math.sqrt(max(0, (half(p, q) + half(q, p)) / 2))


def quality_by_hand(texts, langs, rules):
    """kept, char_distance and word_distance by document, from the definitions."""
    chars, words, out = {}, {}, {}
    sets = [re.compile(f"[{c}]") for c in ("A-Z", "0-9", ".,;:!?'\"()\\-", r"#$%&*+/<=>@\[\\\]^_`{|}~", "^\x00-\x7f", " \t\n\x0b\x0c\r", "a-z")]
    key = {i: langs[i] if langs[i] in rules.common_words else "other" for i in texts}
    for i, t in texts.items():
        n = [len(x.findall(t)) for x in sets]
        chars[i] = [x / len(t) for x in [*n, len(t) - sum(n)]] if t else None
        w = re.findall(SPACE, t)
        shares = [w.count(x) / len(w) for x in rules.common_words.get(key[i], [])] if w else []
        words[i] = [*shares, 1 - sum(shares)] if shares else None
    def middle(held, k):
        own = [held[i] for i in texts if key[i] == k and re.findall(SPACE, texts[i]) and held[i]]
        m = [float(np.median([round(x[j], 4) for x in own])) for j in range(len(own[0]))] if own else []
        return [x / sum(m) for x in m]
    for i, t in texts.items():
        n = len(re.findall(SPACE, t))
        x = js_distance(chars[i], middle(chars, key[i])) if len(t) >= rules.judged_chars and n else None
        y = js_distance(words[i], middle(words, key[i])) if n >= rules.judged_words and key[i] != "other" else None
        bad = n < rules.min_words or 100 * repeats(re.findall(SPACE, t)) > rules.max_repeat_percent * n
        out[i] = (not bad and (x or 0) <= rules.char_distance and (y or 0) <= rules.word_distance, x, y)
    return out


@pytest.mark.parametrize("packed", [65_536, 0])
def test_op10(held, packed):
    docs, texts = held
    got = by_id(quality_rules.judge(docs, quality_rules.Rules(packed_words=packed)))
    assert set(got) == set(texts)
    for i, t in texts.items():
        t = t or ""
        w, lines = re.findall(SPACE, t), [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeats(w))
        assert x.base_failed == (len(w) < 50 or 100 * repeats(w) > 50 * len(w)) and not (x.base_failed and x.kept)


def test_op10_verdicts_equal_the_definition(spark):
    r, rules = random.Random(5), quality_rules.Rules()
    texts, langs = {}, {}
    for i in range(60):
        langs[i] = [*rules.common_words, None, "xx"][i % 6]
        common = rules.common_words.get(langs[i], ["q"])
        w = [r.choice(common) if r.random() < (0.3 if i % 7 else 0.02) else "".join(r.choice("abcdeéz") for _ in range(5)) for _ in range(r.choice([30, 120, 200]))]
        texts[i] = " ".join(x if i % 5 else x.upper() + "#9" for x in w)
    got = by_id(quality_rules.judge(spark.createDataFrame([(i, t, langs[i]) for i, t in texts.items()], "doc_id long, text string, lang string")))
    for i, (kept, x, y) in quality_by_hand(texts, langs, rules).items():
        assert got[i].kept == kept and all((a is None) == (b is None) and (a is None or math.isclose(a, b, abs_tol=1e-9)) for a, b in ((got[i].char_distance, x), (got[i].word_distance, y))), i
    assert {x.kept for x in got.values()} == {True, False}


def test_op10_lines_of_all_white_space(spark):
    """A line counts if it has a word, whatever letters or blanks it has."""
    texts = {1: "0\n0\n0", 2: "b\nb\nb", 3: "0b\n0b\nword\nword", 4: "\x0b\n\x0b\n \x0c\n \x0c", 5: "x\r\nx\nx", 6: "", 7: "\\x0b\n\\x0b"}
    got = by_id(quality_rules.judge(spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")))
    assert {i: x.n_dup_lines for i, x in got.items()} == {1: 2, 2: 2, 3: 2, 4: 0, 5: 1, 6: 0, 7: 1}


CLASHING = ["held_out", "label", "labelled", "score", "words", "spans", "key", "bucket", "n_words", "component_id", "_text", "_0", "gone_id", "items"]


def odd_table(spark):
    """Null and repeated ids, null, blank and very long texts, and columns of every name that operators use inside."""
    long_one = " ".join(f"w{k % 977} the" for k in range(60_000))
    rows = [(None, "one two three four five six"), (None, None), (1, "one two three four five six"), (1, "one two three four five six"), (2, "  "), (3, long_one), (4, None), (5, "x" * 300_000), (6, "one two three four five SIX")]
    schema = "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, "en", *CLASHING) for r in rows], schema).repartition(3)


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op10"])
def test_odd_rows_and_clashing_columns(spark, name):
    docs = odd_table(spark)
    bench = spark.createDataFrame([(1, "two three four", "x"), (None, None, "x"), (1, "two three four", "x")], "item_id long, text string, spans string")
    labels = spark.createDataFrame([(1, 1, 0, "a"), (2, 0, 0, "a"), (3, 1, 0, "a"), (6, 0, 0, "a")], "doc_id long, quality int, toxic int, score string")
    run = {
        "op1": lambda d: licenses.scan(d), "op2": lambda d: sentence_pieces.encode(d, PIECES, digests=True), "op3": lambda d: kneser_ney.train_and_score(d), "op4": lambda d: substring_dedup.deduplicate(d, 4, digests=True),
        "op5": lambda d: ngram_join.link(d), "op6": lambda d: token_files.round_trip(d, WORDS, 1), "op7": lambda d: decontaminate.report(d, bench, 3), "op8": lambda d: quality_model.score(d, quality_model.train(docs, labels)), "op10": lambda d: quality_rules.judge(d),
    }[name]
    got = run(docs).collect()
    assert sorted(x.doc_id or 0 for x in got) == [0, 0, 1, 1, 2, 3, 4, 5, 6]
    same = [tuple(v for c, v in x.asDict().items() if c != "start") for x in got if x.doc_id == 1]
    assert same[0] == same[1]
    assert run(docs.limit(0)).count() == 0
    if name == "op5":
        assert {x.doc_id: x.component_id for x in got if x.doc_id} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 1} and [x.component_id for x in got if x.doc_id is None] == [None, None]
    if name == "op4":
        assert {(x.doc_id, x.n_removed) for x in got if x.doc_id in (None, 1, 6)} == {(None, 0), (1, 0), (6, 5)}
    if name == "op7":
        assert sorted((x.doc_id or 0, x.n_hit, x.n_items) for x in got if x.n_hit) == [(0, 3, 1), (1, 3, 1), (1, 3, 1), (6, 3, 1)]  # both rows are of one item


def test_stages_keep_odd_rows_and_columns(spark, tmp_path):
    """Every stage but the last keeps the columns and the rows that it has nothing against."""
    import corpus_pipeline

    docs = odd_table(spark)
    spark.createDataFrame([(1, "zz yy xx")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = {"quality": 9, "near_duplicates": 8, "repeated_passages": 9, "benchmark_leaks": 9, "tokens": 9}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == left[name] and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        assert name == "tokens" or (out.columns == docs.columns and out.filter("label <> 'label' OR _0 <> '_0'").count() == 0)


def test_pipeline_equals_its_stages_in_plain_python(spark, tmp_path):
    import corpus_pipeline
    import sentencepiece

    texts = {i: t for i, t in TEXTS.items() if i != 4}
    table(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, int(len(t or "") > 40), 0) for i, t in texts.items()], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    item = " ".join(texts[20].split()[:12])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = by_id(corpus_pipeline.run(spark, str(tmp_path)))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = quality_model.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    left = {x.doc_id: x.text for x in quality_model.keep_good(docs, model).collect()}
    sets = sets_of(left, 5)
    parent = {i: i for i in left}
    for _ in left:
        for a in left:
            for b in left:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    parent[a] = parent[b] = min(parent[a], parent[b])
    left = {i: t for i, t in left.items() if parent[i] == i}
    words, gone = windows_gone(left, 50)
    left = {i: " ".join(w for w, g in zip(words[i], gone[i], strict=True) if not g) if any(gone[i]) else t for i, t in left.items()}
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert set(got) == set(left)
    for i, t in left.items():
        w = re.findall(ALNUM, lower(t))
        p = re.findall(ALNUM, lower(item))
        if not any(w[k : k + 10] == p[j : j + 10] for j in range(len(p) - 9) for k in range(len(w))):
            ids = sp.encode(t or "")
            assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert "ledgerlens" in corpus_pipeline.run.__globals__["cut"].__module__
