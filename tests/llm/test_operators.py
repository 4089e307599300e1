import hashlib
import zlib
from collections import Counter

import brute
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratavec.llm import chat, decontam, fingerprint, language, licenses, linededup, neardup, packing, quality, textkit, toxicity
from stratavec.llm.queries import ORACLES, QUERIES
from stratavec.llm.work import Members, Scratch, components, held_out, spread_join

EDGES = [(2**63 - 1, "the last id of all"), (-(2**63), "the first id of all"), (1, None), (2, ""), (3, "word"), (4, "two words"), (4, "two words"), (5, "Ünïcode — text\nwith lines\n\n!!!"), (None, "no id at all here"), (6, "long " * 50_000)]
SHAPE = "doc_id bigint, text string"
OPERATORS = {
    "quality": lambda d, lab: quality.score(d, quality.fit(d, lab)),
    "toxicity": lambda d, lab: toxicity.score(d, toxicity.fit(d, lab)),
    "reject": lambda d, lab: toxicity.reject(d, toxicity.fit(d, lab)),
    "language": lambda d, lab: language.predict(d, language.fit(d)),
    "fingerprint": lambda d, lab: fingerprint.edited_pairs(d),
    "fingerprints": lambda d, lab: fingerprint.fingerprints(d),
    "neardup": lambda d, lab: neardup.near_duplicates(d),
    "keep_one": lambda d, lab: neardup.keep_one(d),
    "packing": lambda d, lab: packing.pack_documents(d),
    "linededup": lambda d, lab: linededup.dedup_lines(d),
    "licenses": lambda d, lab: licenses.scan(d),
    "leaks": lambda d, lab: decontam.remove_leaks(d, d.sparkSession.createDataFrame([(1, "an item of some words that is in no text"), (None, None), (2, "")], "item_id bigint, text string")),
}


def docs_of(spark, rows, **more):
    return spark.createDataFrame(rows, SHAPE).withColumns({"lang": F.lit(None).cast("string"), "score": F.lit("x"), "held_out": F.lit(1), "kept": F.lit(2), "members": F.lit(3)} | {c: F.lit("x") for c in ("_w", "_bits", "_id", "_gone", "_p", "id_", "mark_", "lines_", "word_", "n_removed", "kept_id", "family", "hi", "lo", "line", "key")} | more)


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, name):
    """Nulls, empty and long texts, repeated rows, clashing names; then no rows at all."""
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    run = OPERATORS[name]
    out = run(docs_of(spark, EDGES), labels).collect()
    if name == "keep_one":
        assert sorted((r.doc_id for r in out), key=str) == sorted([2**63 - 1, -(2**63), 1, 2, 3, 4, 5, 6, None], key=str)
    elif name == "packing":
        assert {r.doc_id for r in out} == {r[0] for r in EDGES}
    else:
        assert Counter(r.doc_id for r in out) == Counter(r[0] for r in EDGES)
    assert run(docs_of(spark, []), labels.limit(0)).collect() == []


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    a, b = QUERIES[name](spark, sf_dir).toPandas(), c.sql(ORACLES[name]).df()
    cols = sorted(b.columns)
    assert sorted(a.columns) == cols
    assert sorted(map(tuple, a[cols].astype(str).values)) == sorted(map(tuple, b[cols].astype(str).values))


def documents(sf_dir):
    return duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()


@pytest.mark.parametrize(("width", "num", "den"), [(3, 85, 100), (5, 80, 100)])
def test_near_duplicates_like_brute_force(spark, sf_dir, width, num, den):
    rows = documents(sf_dir)
    rng = np.random.default_rng(5)
    base = " ".join(f"w{i}" for i in range(120)).split()
    for i in range(60):  # a family with edits on both sides of the bound
        words = list(base)
        for at in rng.integers(0, len(words), rng.integers(0, 9)):
            words[at] = f"x{i}{at}"
        rows.append((10_000 + i, " ".join(words)))
    rows += [(20_000 + i, " ".join(f"w{j}" for j in range(i))) for i in range(1, 12)]  # short ones
    expected = brute.near_duplicates(rows, width, num, den)
    for family in (neardup.FAMILY, 2000):  # in one task, and by blocks of queries
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs_of(spark, rows), width, num, den, family=family, block=3000).collect()}
        assert got == expected


def test_a_key_is_in_lists_of_all_that_are_similar():
    rng = np.random.default_rng(0)
    for num in (80, 85):
        for n in [*range(1, 40), 60, 200]:
            for _ in range(20):
                a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
                b = a.copy()
                for _ in range(n):
                    c = b.copy()
                    c[rng.integers(len(c))] = rng.integers(0, 2**63)
                    c = np.unique(c)
                    if len(np.intersect1d(a, c)) * 100 < num * len(np.union1d(a, c)):
                        break
                    b = c
                assert len(np.intersect1d(neardup.list_keys(a, num, 100), neardup.list_keys(b, num, 100)))


def test_line_dedup_like_brute_force(spark, sf_dir):
    rows = documents(sf_dir)[:120]
    long = [f"word{i}" for i in range(70)]
    rows += [(5000 + i, "\n".join(["Short.", " ".join([*long[:i], f"other{i}", *long[i + 1 :]]), f"A line of its own, number {'abcdefgh'[i]}: {i}", " ".join(long).upper() + "!!"])) for i in range(8)]
    sim = lambda x: int.from_bytes(linededup.line_keys([x.encode()])[0].tobytes(), "little")
    gone = brute.removed_lines(rows, linededup.normalise, sim, 1, linededup.DISTANCE, linededup.SIMILARITY)
    assert any(d >= 5000 for d in gone)
    expected = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, [])) for d, t in rows}
    assert {r.doc_id: r.text for r in linededup.dedup_lines(docs_of(spark, rows)).collect()} == expected
    was = linededup.FAMILY_LINES, linededup.LIST
    linededup.FAMILY_LINES, linededup.LIST = 3, 4  # families and lists in parts
    try:
        assert {r.doc_id: r.text for r in linededup.dedup_lines(docs_of(spark, rows)).collect()} == expected
    finally:
        linededup.FAMILY_LINES, linededup.LIST = was


def test_short_lines_and_scripts_without_blanks_are_deduplicated(spark):
    rng = np.random.default_rng(9)
    rows = [(1, "Short.\nTwo words\n行行行"), (2, "short\nTWO  words!\n行行行\n---"), (3, "an extraordinary lime"), (4, "an extraordinary line")]
    text = "".join(map(chr, rng.integers(0x4E00, 0x9F00, 40)))
    rows += [(5, text), (6, text), (7, text[:9] + "字" + text[10:]), (8, text[:30] + text[31:])]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs_of(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "---", 3: rows[2][1], 4: "", 5: text, 6: "", 7: "", 8: ""}


def test_line_dedup_links_by_edit_similarity_alone(spark):
    """Typos, changed and added words, against a comparison of all pairs."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9)))
    lines = []
    for n in (5, 10, 20, 30, 50):
        for _ in range(4):
            words = [word() for _ in range(n)]
            typo, other, more = " ".join(words), list(words), list(words)
            at = int(rng.integers(len(typo)))
            other[int(rng.integers(n))] = word()
            more.insert(int(rng.integers(n)), "ab")
            lines += [" ".join(words), typo[:at] + "q" + typo[at + 1 :], " ".join(other), " ".join(more)]
    rows = [(i, x) for i, x in enumerate(lines)]
    plain = [linededup.normalise(x) for x in lines]
    links = [(i, j) for i in range(len(plain)) for j in range(i) if linededup.similar(plain[i], plain[j])]  # all pairs; edits has a test of its own
    first = {}
    expected = {i for i, g in enumerate(brute.components(len(plain), links)) if first.setdefault(g, i) != i}
    assert len(expected) > 50
    got = {r.doc_id for r in linededup.dedup_lines(docs_of(spark, rows)).where("n_removed > 0").collect()}
    assert got == expected


@given(st.text("abc", max_size=40), st.text("abc", max_size=40))
@settings(max_examples=300, deadline=None)
def test_edit_distance(a, b):
    d = brute.edit_distance(a, b)
    assert linededup.edits(a, b, 100) == d
    assert (linededup.edits(a, b, 5) <= 5) == (d <= 5)


@given(st.lists(st.integers(1, 2047), min_size=1, max_size=60))
@settings(max_examples=100, deadline=None)
def test_packing_fills_windows(lengths):
    out = packing.pack(lengths, 2048)
    assert sorted(i for w in out for i in w) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in w) <= 2048 for w in out)


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), max_size=5), st.integers(0, 60))
@settings(max_examples=200, deadline=None)
def test_fill_is_the_best_subset(counts, room):
    reach = {0}
    for n, k in counts.items():
        reach |= {s + n * j for s in reach for j in range(1, k + 1)}
    got = packing.fill(counts, room)
    assert sum(n * k for n, k in got) == max(s for s in reach if s <= room)
    assert all(0 < k <= counts[n] for n, k in got)


def test_packed_ids_are_the_tokenizers(spark, sf_dir):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [*documents(sf_dir)[:60], (9001, None), (9002, "a <|endoftext|> b"), (9003, " \n\t  é ß 中文 🙂 "), (9004, "x" * 9000)]
    pieces = packing.pack_documents(docs_of(spark, rows), batch=50).collect()
    by = {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
    for d, t in rows:
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(by[d], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for s in {p.sequence_id for p in pieces}:
        at = 0
        for p in sorted((p for p in pieces if p.sequence_id == s), key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.WINDOW


TEXT = st.lists(st.sampled_from(["\\", "### ", "</turn>", "<|", ": ", "\n", "Assistant", "a", "é", "|>"]), max_size=12).map("".join)


@given(TEXT, st.sampled_from(["user", "assistant", "", "Odd: role", "=x", "### "]))
@settings(max_examples=300, deadline=None)
def test_chat_reads_back(text, role):
    formatted, _, spans = chat.format_turn(role, [{"type": "text", "text": text}])
    got_role, content = chat.read_turn(formatted)
    assert (got_role, chat.unescape(content)) == (role, text)
    assert [chat.unescape(formatted[a:z]) for a, z in spans] == [text] * (role == "assistant")


def test_digest_reads_the_loss_mask():
    """A wrong mask changes the digest of what is learned, and nothing else."""
    formatted, flat, spans = chat.format_turn("assistant", [{"type": "text", "text": "a \\\\ b"}, {"type": "image", "ref": "x", "size": 1}])
    rows = []
    for mask in (spans, [(spans[0][0], spans[0][1] - 1)], []):
        d = chat.Digest(1)
        d.add(formatted, flat, mask)
        rows.append(d.row())
    assert len({r[4] for r in rows}) == 3 and len({r[:3] + r[5:] for r in rows}) == 1
    assert rows[0][6:] == (1, 255)


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (2, 0, "assistant", "long " * 200_000), (None, 0, "user", "who"), (None, None, "assistant", "")]
    shape = "conv_id bigint, turn bigint, role string, text string"
    clash = {c: F.lit("x") for c in ("n_turns", "loss_chars", "turns_sha256")}
    got = {r.conv_id: r for r in chat.format_table(spark.createDataFrame(rows, shape).withColumns(clash)).collect()}
    assert {c: (r.n_turns, r.loss_chars) for c, r in got.items()} == {1: (3, 0), 2: (1, 1_000_000), None: (2, 0)}
    assert chat.format_table(spark.createDataFrame([], shape)).collect() == []


def test_rows_of_one_id_with_unlike_texts_stay(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    got = Counter((r.doc_id, r.text) for r in neardup.keep_one(docs_of(spark, [(1, a), (1, a), (2, a), (3, b), (1, b)])).collect())
    assert got == {(1, a): 1, (1, b): 1}


def test_toxicity_learns_from_few_rows():
    """FTRL on a handful of rows, step by step against the plain recurrences."""
    rows = [(np.array(sorted(x), np.int32).tobytes(), y) for x, y in [({1, 2}, 1), ({1, 3}, 1), ({1, 5}, 1), ({4, 5}, 0), ({4}, 0), ({4, 6}, 0)]]
    ids, w, bias = toxicity.train(rows, (3, 3))
    data, seen = sorted(rows), Counter(i for x, _ in rows for i in np.frombuffer(x, np.int32).tolist())
    z, n, order = Counter(), Counter(), np.random.default_rng(7)
    weight = lambda i: 0.0 if abs(z[i]) <= (0 if i < 0 else toxicity.L1) else -(z[i] - np.sign(z[i]) * (0 if i < 0 else toxicity.L1)) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)
    for _ in range(toxicity.EPOCHS):
        for k in order.permutation(len(data)):
            at = [i for i in np.frombuffer(data[k][0], np.int32).tolist() if seen[i] >= toxicity.SEEN] + [-1]
            g = 1 / (1 + np.exp(-sum(weight(i) for i in at))) - data[k][1]
            new = {i: g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * weight(i) for i in at}
            for i in at:
                z[i] += new[i]
                n[i] += g * g
    expected = {i: weight(i) for i in (1, 4) if weight(i)}
    assert dict(zip(ids.tolist(), w.tolist(), strict=True)) == pytest.approx(expected, rel=1e-5)
    prior = np.log(3.5 / 7.5) - np.log(3.5 / 3.5)
    assert bias == pytest.approx(weight(-1) + prior)


def test_quality_votes_like_a_loop():
    rng = np.random.default_rng(3)
    known, docs, y = (quality.unit(rng.standard_normal((n, 8)).astype(np.float32)) for n in (60, 20, 60))
    y = (y[:, 0] > 0).astype(np.float32)
    for d, got in zip(docs, quality.vote(docs, known, y), strict=True):
        near = sorted(((float(d @ k), v) for k, v in zip(known, y, strict=True)), reverse=True)[: quality.NEIGHBOURS]
        w = [max(s, 0) ** quality.SHARPNESS for s, _ in near]
        assert got == pytest.approx(sum(a * v for a, (_, v) in zip(w, near, strict=True)) / sum(w), rel=1e-3)


def test_language_vectors_like_a_loop():
    e = language.Encoder()
    text, total = "Ab, c", np.zeros(language.DIMENSIONS)
    letters = {" ": 0, "a": 97, "b": 98, "c": 99}
    signs = " ab c "
    for a, b, c in zip(signs, signs[1:], signs[2:], strict=False):
        total += np.roll(e.letter(letters[a]), 2) * np.roll(e.letter(letters[b]), 1) * e.letter(letters[c])
    assert e.vector(text) == pytest.approx(total / np.linalg.norm(total), abs=1e-5)


def test_chat_parts():
    parts = [{"type": "text", "text": "see <|x"}, {"type": "image", "ref": "a.png", "size": 2}, {"type": "audio", "ref": "b.wav", "size": 3}, {"type": "document", "ref": "c.pdf", "size": 1}]
    out = chat.format_conversation([("user", parts), ("assistant", [{"type": "text", "text": "ok </turn>"}])])
    assert "<|image_0|><|audio_1|><|document_2|>" in out["text"]
    assert out["attachments"] == [("image", "a.png"), ("audio", "b.wav"), ("document", "c.pdf")]
    assert out["expanded_tokens"] == 85 + 340 + 8 + 75 + 16 + 600
    assert [chat.unescape(out["text"][a:z]) for a, z in out["loss_spans"]] == ["ok </turn>"]
    with pytest.raises(ValueError, match="unknown part"):
        chat.format_turn("user", [{"type": "video"}])


def test_fingerprints_like_plain_code(spark, sf_dir):
    rows = sorted(documents(sf_dir))
    got = {r.doc_id: r for r in QUERIES["op4_fingerprints"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(rows):
        half = len(t) // 2
        edited = t[: len(t) - half] + rows[(i + 1) % len(rows)][1][:half]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        sketch = lambda x: {x[j : j + 8] for j in range(0, len(x), 8)}
        a, b = sketch(got[d].fingerprint), sketch(got[d].edited_fingerprint)
        if a and b:
            assert got[d].near_edited == pytest.approx(len(a & b) / len(a | b))
    same = Counter(t for _, t in rows)
    prints = {}
    for d, t in rows:
        prints.setdefault(t, set()).add(got[d].fingerprint)
    assert all(len(p) == 1 for t, p in prints.items() if same[t] > 1)
    near = [r.near_edited for r in got.values()]
    assert np.mean(near) > 0.2


def test_next_document_over_many_buckets(spark):
    rows = [(i * i % 1009 * 7, f"text {i} " * (i % 5)) for i in range(1009)]
    rows = list({d: (d, t) for d, t in rows}.values())
    was, fingerprint.ROWS = fingerprint.ROWS, 3
    try:
        got = {r.doc_id: r.next_text for r in fingerprint.with_next(docs_of(spark, rows)).collect()}
    finally:
        fingerprint.ROWS = was
    order = sorted(rows)
    assert got == {d: order[(i + 1) % len(order)][1] for i, (d, _) in enumerate(order)}


def test_leaks_like_brute_force(spark, sf_dir):
    items = duckdb.sql(f"select item_id, text from '{sf_dir}/benchmark.parquet'").fetchall()
    rows = documents(sf_dir)
    rows += [(7000 + i, f"Before it, {rows[i][1][:200]} {t.upper()} and after {rows[i + 1][1][:300]}") for i, (_, t) in enumerate(items[:10])]
    df = docs_of(spark, rows)
    table = spark.createDataFrame([*items, (None, None), (-1, ""), (-2, "!!")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(df, table).collect()}
    words = {i: textkit.plain_words(t) for i, t in items}
    grams = lambda w: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    expected = set()
    for d, t in rows:
        g = grams(textkit.plain_words(t))
        expected |= {(d, i) for i, w in words.items() if len(grams(w) & g) >= 0.8 * len(grams(w))}
    assert expected <= got and len(got) == len(expected)
    assert {d for d, _ in got} >= set(range(7000, 7010))
    left = {r.doc_id for r in decontam.remove_leaks(df, table).collect()}
    assert left == {d for d, _ in rows} - {d for d, _ in got}


def test_wand_returns_all_above_the_threshold(sf_dir):
    items = duckdb.sql(f"select item_id, text from '{sf_dir}/benchmark.parquet'").fetchall()
    index = decontam.Index(items)
    dense = np.zeros((len(index.words), len(index.ids)))
    for w, own in index.items.items():
        dense[w, own] = index.impacts[w]
    rng = np.random.default_rng(3)
    for _ in range(100):
        terms = rng.choice(len(index.words), rng.integers(1, 60), replace=False).tolist()
        scores = dense[terms].sum(0)
        for t in (0.1, 0.3, 0.6):
            assert {i for i, _ in index.search(terms, t)} >= set(np.flatnonzero(scores >= t + 1e-9).tolist())
            assert all(scores[i] >= t - 1e-6 for i, _ in index.search(terms, t))


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    parts = mit.split("\n\n")
    rows = [(1, mit), (2, "\n\n".join(reversed(parts))), (3, "Prose.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License."), (4, "No licence needed.")]
    got = {r.doc_id: r.licenses for r in licenses.scan(docs_of(spark, rows)).collect()}
    assert got == {1: "MIT", 2: "", 3: "CC-BY-NC-4.0,MIT", 4: ""}
    assert all(any(stem in s for stem in licenses.STEMS) for s in licenses.by_sentence())


def test_wrapped_public_domain(spark):
    said = "This is free and unencumbered software released into the public{}domain."
    got = [r.licenses for r in licenses.scan(docs_of(spark, [(i, said.format(x)) for i, x in enumerate((" ", "\n", "  "))])).collect()]
    assert got == ["Unlicense"] * 3


def test_classifiers_held_out(spark):
    """On rows that weren't learned from."""
    sf = "/root/testdata/sf0.01"
    labels = {r[0]: r[1:] for r in duckdb.sql(f"select doc_id, quality, toxic from '{sf}/labels.parquet'").fetchall()}

    def auc(rows, at):
        own = [(r.score, labels[r.doc_id][at]) for r in rows if r.held_out and r.doc_id in labels]
        high, low = [s for s, y in own if y], [s for s, y in own if not y]
        return np.mean([(a > b) + (a == b) / 2 for a in high for b in low])

    assert auc(QUERIES["op1_quality"](spark, sf).collect(), 0) > 0.95
    assert auc(QUERIES["op2_toxicity"](spark, sf).collect(), 1) > 0.75  # some 330 labelled rows; 0.98 with 3,000
    langs = dict(duckdb.sql(f"select doc_id, lang from '{sf}/documents.parquet'").fetchall())
    out = [r for r in QUERIES["op3_language"](spark, sf).collect() if r.held_out and langs[r.doc_id]]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in out]) > 0.98


def test_language_without_letters(spark):
    model = (["en"], np.ones((1, language.DIMENSIONS), np.float32))
    got = [(r.lang_pred, r.score) for r in language.predict(docs_of(spark, [(1, None), (2, "123 !?")]), model).collect()]
    assert got == [("und", 0.0)] * 2


def test_held_out_is_crc32(spark):
    for r in spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0)


def test_components_and_spread_join(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 150, (110, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2050)]
    scratch = Scratch(spark)
    got = {r.node: r.label for r in components(spark, spark.createDataFrame(edges, "a bigint, b bigint"), "bigint", scratch, "t").collect()}
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    place = {x: i for i, x in enumerate(nodes)}
    label = brute.components(len(nodes), [(place[a], place[b]) for a, b in edges if a != b])
    least = {}
    for x in nodes:
        least.setdefault(label[place[x]], x)
    assert got == {x: least[label[place[x]]] for x in nodes}
    rows = spark.createDataFrame([(i, 1 if i % 2 else i) for i in range(2000)], "n bigint, k bigint")
    table = spark.createDataFrame([(1, 1000, "hot"), (4, 1, "cold")], "k bigint, members bigint, v string")
    assert Counter(r.v for r in spread_join(rows, table, ["k"], "v").collect()) == {"hot": 1000, "cold": 1, None: 999}


def test_members_lets_all_of_the_set_through(spark):
    ids = spark.range(0, 5000, 7).withColumnRenamed("id", "x")
    rows = docs_of(spark, [(i, "t") for i in range(3000)])
    inside = {r.doc_id for r in Members(ids).pick(rows, "doc_id").collect()}
    outside = {r.doc_id for r in Members(ids).pick(rows, "doc_id", inside=False).collect()}
    assert inside >= set(range(0, 3000, 7)) and len(inside) < 450
    assert inside | outside == set(range(3000)) and not inside & outside


def test_forest_joins_what_is_near():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, (40, 2)).astype(np.uint64)
    near = np.repeat(base[:3], 8, axis=0) ^ (np.uint64(1) << rng.integers(0, 60, (24, 2)).astype(np.uint64))
    sims = np.concatenate([base, near])
    pairs = {(i, j) for i in range(len(sims)) for j in range(i) if sum(int(x).bit_count() for x in sims[i] ^ sims[j]) <= linededup.DISTANCE}
    label = brute.components(len(sims), pairs)
    ties = linededup.forest(sims)
    assert len(ties) == len(sims) - len(set(label))
    again = brute.components(len(sims), ties)
    assert len(set(zip(label, again, strict=True))) == len(set(label))


@pytest.mark.parametrize("most", [None, 5, 1000])
def test_lists_over_batches(most):
    """Every row of a list is in its set or passed on, wherever batches end."""
    rng = np.random.default_rng(1)
    key = np.sort(rng.choice([3, 4, 5, 6, 9], 200, p=[0.02, 0.02, 0.6, 0.06, 0.3]))
    rows = [key, np.arange(200), np.zeros(200, np.int64), np.zeros(200, np.int64)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + 7]) for x in rows], ["key", "hi", "s", "t"]) for i in range(0, 200, 7)]

    class Rows:  # stands for a DataFrame
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: [r for b in run(iter(batches)) for r in b.to_pylist()]

    out = linededup.cluster(Rows(), most)
    passed = {(r["key"], r["hi"]) for r in out if r["s"] is not None}
    sets = {}
    for r in out:
        if r["s"] is None:
            sets.setdefault(r["key"], set()).add(r["hi"])
    lists = [set(np.flatnonzero(key == k).tolist()) for k in np.unique(key).tolist()]
    assert sorted(map(sorted, sets.values())) == sorted(sorted(x) for x in lists if 1 < len(x) <= (most or 1000))
    assert {h for _, h in passed} == {h for x in lists if len(x) > (most or 1000) for h in x}


@given(st.lists(st.none() | st.text(" ab\n\t.é1", max_size=30), max_size=6))
@settings(max_examples=300, deadline=None)
def test_lines_are_normalised_together_as_alone(texts):
    expected = [(i, k, n) for i, t in enumerate(texts) for k, line in enumerate((t or "").split("\n")) if (n := linededup.normalise(line))]
    text, number, body, start, end = linededup.normal_lines(texts)
    assert [(i, k, body[a:z].decode()) for i, k, a, z in zip(text.tolist(), number.tolist(), start.tolist(), end.tolist(), strict=True)] == expected


@given(st.lists(st.sampled_from("a bb abc abd é".split()), max_size=12), st.lists(st.sampled_from("a bb abc abd é".split()), max_size=12))
@settings(max_examples=300, deadline=None)
def test_aligned_words_are_an_upper_bound(x, y):
    assert linededup.aligned(x, y) + 1 >= brute.edit_distance(" ".join(x), " ".join(y)) and (x != y or linededup.aligned(x, y) == 0)
    if x and y:
        assert linededup.aligned(x, y) >= brute.edit_distance(" ".join(x), " ".join(y))


@given(st.lists(st.tuples(st.text("abé", max_size=25), st.text("abé", max_size=25), st.integers(0, 8)), max_size=12))
@settings(max_examples=300, deadline=None)
def test_distances_computed_together(pairs):
    assert linededup.close(pairs) == [brute.edit_distance(a, b) <= most for a, b, most in pairs]


def test_distances_of_longer_lines_computed_together():
    rng = np.random.default_rng(12)
    pairs = []
    for n in [*range(1, 80), *range(280, 700, 7), *range(1200, 1400, 50)]:
        a = "".join(rng.choice(list("abcdé" if n % 2 else "ab\u4e00"), n))
        for share in (0.03, 0.09, 0.15, 0.5):
            b = list(a)
            for _ in range(int(share * n) + 1):
                at = int(rng.integers(len(b) + 1))
                b[at : at + int(rng.integers(2))] = rng.choice(list("abx"), int(rng.integers(2))).tolist()
            pairs += [(a, "".join(b), n // 10), ("".join(b), a, max(n, len(b)) // 10)]
    expected = [linededup.edits(a, b, most) <= most for a, b, most in pairs]
    assert 200 < sum(expected) < len(pairs) - 200
    assert linededup.close(pairs) == expected


@given(st.lists(st.text("ab ", max_size=25), min_size=2, max_size=2))
@settings(max_examples=300, deadline=None)
def test_profiles_bound_edits(lines):
    g = linededup.profiles(lines)
    assert np.abs(g[0] - g[1]).sum() <= 6 * brute.edit_distance(*lines)


@pytest.mark.parametrize("size", [1, 7, 300, 70_000])
def test_halves_are_those_of_words(size):
    """A word's hashes don't depend on its place, in texts of any length."""
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdé"), rng.integers(1, 9))).encode() for _ in range(size)] + [b"x" * 200_000] * (size == 300)
    a, z, n = linededup.halves(b" ".join(words))
    assert n.tolist() == [len(w) for w in words]
    seen = {}
    for w, x, y in zip(words, a.tolist(), z.tolist(), strict=True):
        half = (len(w) + 1) // 2
        assert seen.setdefault((0, w[:half]), x) == x and seen.setdefault((1, w[-half:]), y) == y
    assert len(set(seen.values())) == len(seen)


def test_sets_of_lines_are_linked_like_a_loop():
    rng = np.random.default_rng(15)
    base = ["".join(rng.choice(list("abcdefgh "), 40)).strip() for _ in range(6)]
    sets = []
    for n in (2, 2, 1, 2, 5, 9, 3, 2):
        own = {}
        while len(own) < n:
            x = list(base[int(rng.integers(3))])
            for at in rng.integers(0, len(x), int(rng.integers(0, 6))):
                x[at] = "z"
            own.setdefault(linededup.normalise("".join(x)))
        sets.append(list(own))
    lines = [x for s in sets for x in s]
    sims = np.zeros((len(lines), 2), np.uint64)
    label = linededup.link_lines(lines, sims, linededup.profiles(lines), [len(s) for s in sets])
    at = 0
    for s in sets:
        near = [(i, j) for i in range(len(s)) for j in range(i) if brute.edit_distance(s[i], s[j]) <= int(0.1 * max(len(s[i]), len(s[j])) + 1e-9)]
        expected, got = brute.components(len(s), near), label[at : at + len(s)].tolist()
        assert len(set(zip(expected, got, strict=True))) == len(set(expected)) == len(set(got))
        at += len(s)


def test_lowest_shingles():
    rng = np.random.default_rng(7)
    sizes = rng.integers(1, 12, 50)
    h = rng.integers(0, 40, sizes.sum()).astype(np.uint64)
    own, keys = linededup.lowest(h, sizes, 4, 9)
    at = 0
    for i, n in enumerate(sizes.tolist()):
        expected = np.unique(textkit.ngrams(h[at : at + n], min(4, n)))[: linededup.LOWEST[n >= 9]]
        assert sorted(keys[own == i].tolist()) == expected.tolist()
        at += n


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n, scratch = docs.count(), Scratch(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = scratch.keep(stage(spark, docs, sf_dir), name)
        assert out.columns == docs.columns
        assert out.count() <= docs.count()
        if name == "line_dedup":
            assert out.count() == docs.count()
        docs = out
    assert n * 0.7 < docs.count() < n
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_scratch_keeps_no_shuffle_files(spark):
    import time

    from stratavec.llm.work import CLEANUP

    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {str(f) for f in manager.getAllBlocks().mkString("\n").split("\n") if f.startswith("shuffle")}
    before, conf = files(), spark.conf.get(CLEANUP)
    kept = Scratch(spark).keep(spark.range(1000).repartition(3, "id"), "t")
    for _ in range(50):  # they go in the background
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and spark.conf.get(CLEANUP) == conf
    assert kept.count() == 1000


def test_used_up_tables_are_dropped(spark, monkeypatch):
    import os

    made = []
    init = Scratch.__init__
    monkeypatch.setattr(Scratch, "__init__", lambda self, s: (init(self, s), made.append(self.root.removeprefix("file://")))[0])
    line = "the quick brown fox jumps over the lazy dog again and again"
    docs = spark.createDataFrame([(1, f"{line}\nown line"), (2, line), (3, line.replace("quick", "quack"))], "doc_id bigint, text string")
    assert [r.text for r in linededup.dedup_lines(docs).orderBy("doc_id").collect()] == [f"{line}\nown line", "", ""]
    neardup.keep_one(docs).count()
    assert [sorted(os.listdir(x)) for x in made] == [["gone"], ["described", "named"]]


def test_distance_of_long_lines_is_exact_up_to_the_limit():
    import random

    r = random.Random(3)
    a = "".join(r.choice("abcdefgh ") for _ in range(1500))
    b = a[:200] + "".join(r.choice("abcdefgh ") for _ in range(130)) + a[320:900] + a[930:]
    d = brute.edit_distance(a, b)
    assert linededup.edits(a, b, d) == d == linededup.edits(b, a, d + 40) and linededup.edits(a, b, d - 1) >= d
    assert linededup.edits(a, "".join(r.choice("ijk") for _ in range(1500)), 150) > 150
