"""Personal data, decontamination, repeats, near duplicates and packing, against brute force."""

import random
import tracemalloc
import unicodedata
import re
from dataclasses import replace

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from keysieve.llm import decontamination, ngram_join, packing, pii, suffix_dedup
from keysieve.llm.common import split_words

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    worth = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(w - 9 * (w > 9) for w in worth) % 10 == 0


def base(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "ip" and any(int(p) > 255 for p in m.group().split("."))
                    or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits))
                    or kind == "phone" and not 10 <= len(digits) <= 15):
                continue
            found.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_base_spans_against_python(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("0123456789.@+ -()aé_%") for _ in range(rng.randint(0, 120))) for _ in range(300)]
    texts += ["x 4565410125667261 4565 4101-2566 7261 +1 (619) 555-0053 1.2.3.4.5.6.7.8 999.1.1.1 1.2.3.99999999999 a@b.c.@d.e", None, "",
              "1" * 5000, "1 " * 4000, "a" * 20000 + "@", "1.1.1.1 " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = pii.find_pii(docs).select("doc_id", pii.spans_text(F.col("base")).alias("b")).collect()
    assert {r["doc_id"]: r["b"] for r in got} == {i: base(t) for i, t in enumerate(texts)}
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and {r["spans"] for r in clean.collect()} == {"clash"}
    assert pii.redact(docs.limit(0)).count() == 0


def test_trees_add_spans_and_redaction_keeps_the_rest(spark):
    rng = random.Random(6)
    number = lambda: f"{rng.randint(200, 999)} {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    rows = [(i, f"call phone +1 {number()} or write a{i}@x{i % 9}.org now") for i in range(200)]
    rows += [(1000 + i, f"order build {rng.randint(10**8, 10**9)} page {rng.randint(1, 999)} ver 1.2.{rng.randint(256, 999)}.4") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trees = pii.fit_trees(docs)
    assert trees.model is not None
    found = pii.find_pii(docs, trees=trees).collect()
    assert all(set(map(tuple, r["base"])) <= set(map(tuple, r["spans"])) for r in found)
    assert all(not r["spans"] for r in found if r["doc_id"] >= 1000)
    text = spark.createDataFrame([(1, "ü mail a@b.c, +1 (619) 555-0053!")], "doc_id long, text string")
    assert pii.redact(text, trees=trees).first()["text"] == "ü mail <EMAIL>, <PHONE>!"


def test_trees_add_spelled_out_and_hexadecimal_addresses_and_numbers_without_plus(spark):
    rng = random.Random(7)
    n = lambda a, b: rng.randint(a, b)
    rows = []
    for i in range(600):
        name = "abcdefghijkl"[:n(2, 12)]
        rows.append(f"{rng.choice(['write', 'ask', 'mail', 'see'])} {name}@{name}{'.co' * n(0, 1)}.org or "
                    f"{rng.choice(['call', 'dial', 'phone'])} +{n(1, 99)} {n(20, 999)} {n(200, 999)}-{n(1000, 9999)}, "
                    f"{rng.choice(['host', 'ping', 'at'])} {n(1, 255)}.{n(0, 255)}.{n(0, 255)}.{n(0, 255)}")
        rows.append(f"{rng.choice(['order', 'invoice', 'serial', 'build'])} {n(100, 999)}-{n(100, 999)}-{n(1000, 9999)}, "
                    f"version {n(1, 9)}.{n(0, 9)}.{n(256, 999)}.{n(0, 99)}, {n(10 ** 7, 10 ** 9)} rows, dated {n(1990, 2030)}-{n(10, 12)}-{n(10, 28)}")
        rows.append(f"we look at page{n(1, 9)}.org")
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    trees = pii.fit_trees(docs)
    wanted = {"mail jane [at] host dot org now": "jane [at] host dot org", "host 2001:db8:0:0:0:ff00:42:8329 is up": "2001:db8:0:0:0:ff00:42:8329",
              "call (017) 555-7713 today": "(017) 555-7713", "order 617-555-7713 came": None, "dated 2024-10-15 here": None,
              "we look at page7.org": None}
    asked = spark.createDataFrame([(t,) for t in wanted], "text string")
    for r in pii.find_pii(asked, trees=trees).collect():
        assert not r["base"]
        assert [r["text"][x["start"]:x["end"]] for x in r["spans"]] == ([wanted[r["text"]]] if wanted[r["text"]] else [])


def test_the_threshold_counts_rare_forms_too(spark):
    rng = random.Random(12)
    rows = [f"call +{'1' * (i % 3 + 1)} {'617'[:i % 2 + 2]} {'5' * (i % 4 + 3)} 0053{'.' * (i % 2)}" for i in range(24) for _ in range(20)]
    rows += [f"mail {'abcdefghijklmnopqrstuvwxyz'[:i + 1]}@{'x' * (i % 5 + 1)}.org" for i in range(24) for _ in range(20)]
    rows += [f"{'1' * (i + 2)} rows" for i in range(10) for _ in range(20)]
    for _ in range(400):      # numbers that pass the check, in order contexts: rare forms without personal data
        parts = ["7" * rng.randint(2, 4) for _ in range(rng.randint(3, 5))]
        rows.append("order " + "".join(p + rng.choice("-. ") for p in parts[:-1]) + parts[-1] + ";")
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    trees = pii.fit_trees(docs, how=pii.Trees(rows=40))
    assert trees.model is not None and trees.threshold == 1.0


def brute_align(item, words):
    table = np.zeros((len(item) + 1, len(words) + 1), dtype=int)
    for i, a in enumerate(item):
        for j, b in enumerate(words):
            table[i + 1, j + 1] = max(0, table[i, j] + (2 if a == b else -1), table[i, j + 1] - 1, table[i + 1, j] - 1)
    return table.max() / (2 * len(item))


def test_alignment_against_the_plain_recurrence():
    rng = np.random.default_rng(1)
    for _ in range(40):
        item, words = (rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64) for _ in range(2))
        score, begin, end = decontamination.align(item, words, decontamination.Alignment())
        assert score == brute_align(item, words) == brute_align(item, words[begin:end])


def test_an_alignment_of_a_repeated_word_needs_little_memory():
    item, words = np.array([7, 8] * 150, dtype=np.uint64), np.full(400_000, 7, dtype=np.uint64)
    tracemalloc.start()
    assert decontamination.align(item, words, decontamination.Alignment())[0] > 0
    assert tracemalloc.get_traced_memory()[1] < 60_000_000
    tracemalloc.stop()


def test_parts_other_marks_other_spaces_and_scripts_without_spaces(spark):
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    text = lambda n: [word() for _ in range(n)]
    long, spaced, cafe = text(300), text(30), [w + rng.choice(["é", "ü", ""]) for w in text(25)]
    quoted = "\u201cIt isn\u2019t far\u201d \u2013 " + " ".join(text(20)) + "\u2026 don\u2019t go"
    han = "".join(chr(rng.randint(0x4E00, 0x9F00)) for _ in range(40))
    thai = "".join(chr(rng.randint(0x0E01, 0x0E2E)) + rng.choice(["", "\u0e34"]) for _ in range(40))
    items = [" ".join(long), " ".join(spaced), quoted, han, thai, " ".join(cafe)]
    ascii_marks = quoted.translate({0x201C: '"', 0x201D: '"', 0x2019: "'", 0x2013: "-", 0x2026: "..."})
    around = lambda inside: " ".join(text(30)) + inside + " ".join(text(30))
    rows = [around(" " + " ".join(long[90:210]) + " "), around("\u00a0" + "\u00a0".join(spaced) + "\u2003"), around(" " + ascii_marks + " "),
            chr(0x4E8C) * 9 + han + chr(0x4E09) * 9, "\u0e01" * 9 + thai + "\u0e02" * 9,
            around(" " + unicodedata.normalize("NFD", " ".join(cafe)).replace("a", "a\u00ad") + " ")]
    clean = [around(" " + " ".join(long[100:130]) + " "), han[:9] + chr(0x4E8C) * 60, around(" ".join(cafe[:6]))]
    docs = spark.createDataFrame(list(enumerate(rows + clean)), "doc_id long, text string")
    tests = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontamination.contamination(docs, tests).select("doc_id", F.explode("copies.item_id").alias("i")).collect()
    assert sorted((r.doc_id, r.i) for r in found) == [(i, i) for i in range(len(items))]


def test_copies_with_edits_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = {i: text(30) for i in range(12)}
    items[12] = ["the"] * 3 + items[0][:8]
    edited = {i: [w if rng.random() > 0.15 else "new" for w in items[i]] for i in range(12)}
    rows = [(i, " ".join(text(50) + edited[i] + text(50)).upper()) for i in range(12)]
    rows += [(100 + i, " ".join(text(120))) for i in range(60)] + [(200, None), (201, ""), (0, rows[0][1])]
    rows += [(300 + i, " ".join(text(5) + items[3] + text(5))) for i in range(80)]      # one item leaked into most rows
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("copies", F.lit("clash"))
    tests = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(98, None), (99, ""), (1, " ".join(items[1]))], "item_id long, text string")
    for how in (decontamination.Alignment(), replace(decontamination.Alignment(), block_items=4)):
        found = decontamination.contamination(docs, tests, how=how, name="c").select("doc_id", F.explode("c.item_id").alias("i"))
        pairs = {(r["doc_id"], r["i"]) for r in found.collect()} - {(d, 12) for d, _ in rows}
        assert pairs == {(i, i) for i in range(12)} | {(300 + i, 3) for i in range(80)}
    left = decontamination.decontaminate(docs, tests)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [*range(100, 160), 200, 201]
    assert decontamination.decontaminate(docs, tests.limit(0)).count() == len(rows)
    assert decontamination.decontaminate(docs.limit(0), tests).count() == 0


def brute_removed(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = {}
    for b in bodies:
        for i in range(len(b) - length + 1):
            seen[b[i:i + length]] = seen.get(b[i:i + length], 0) + 1
    result = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        result.append((len(b), sum(gone), spans, bytes(x for x, y in zip(b, gone) if not y)))
    return result


@pytest.mark.parametrize("how", [suffix_dedup.Repeats(40, 8, 15), suffix_dedup.Repeats(60, 16, 1000)])
def test_repeats_against_brute_force(spark, how):
    rng = random.Random(8)
    words = ["the", "of", "and", "über", "thing", "nation", "er", "in"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(12) for _ in range(5)]
    rows = [(i, text(rng.randint(0, 20)) + " ".join(rng.choice(shared)[rng.randint(0, 5):] for _ in range(rng.randint(0, 3))) + text(rng.randint(0, 9)))
            for i in range(150)]
    rows += [(900, None), (901, ""), (902, "ab" * 300), (903, "x" * 150), (904, shared[0] * 4), (905, shared[0] * 4), (905, shared[0] * 4), (None, shared[1] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("body", F.lit("clash"))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))
                 for r in suffix_dedup.remove_repeats(docs, how=how).collect())
    want = brute_removed([t for _, t in rows], how.length)
    assert got == sorted((-1 if d is None else d, *w) for (d, _), w in zip(rows, want))


def test_repeats_of_an_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def jaccard(a, b):
    sets = [{tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for w in (split_words(a), split_words(b))]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 0.0


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(9)
    text = lambda n: [f"w{rng.randint(0, 500)}" for _ in range(n)]
    texts = []
    for _ in range(12):
        first = text(120)
        for edits in (0, 0, 1, 2, 3, 5, 9):
            copy = list(first)
            for at in rng.sample(range(120), edits):
                copy[at] = "edit"
            texts.append(" ".join(copy))
    texts += [" ".join(text(60)) for _ in range(30)] + ["a b", "a b", "a b c", "", None, "  "]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))
    for block in (512, 3):
        got = ngram_join.near_duplicates(docs, forest=replace(ngram_join.Forest(), block=block)).collect()
        distinct = sorted({t or "" for t in texts})
        links = {a: [b for b in distinct if a != b and jaccard(a, b) >= 0.8] for a in distinct}
        root = {}
        for a in distinct:
            if a not in root:
                edge, group = [a], {a}
                while edge:
                    edge = [y for x in edge for y in links[x] if y not in group and not group.add(y)]
                name = min(i for i, t in rows if (t or "") in group)
                root.update(dict.fromkeys(group, name))
        want = sorted((i, root[t or ""], len(links[t or ""]), sum((u or "") == (t or "") for _, u in rows)) for i, t in rows)
        assert sorted((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in got) == want
    kept = ngram_join.one_of_each_class(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root.values()))
    assert ngram_join.one_of_each_class(docs.limit(0)).count() == 0


def test_forest_depth_follows_the_recall():
    forest = ngram_join.Forest()
    depth = forest.depth()
    assert 1 - (1 - 0.8 ** depth) ** forest.trees >= forest.recall
    assert replace(forest, recall=0.9).depth() >= depth >= replace(forest, recall=0.9999999).depth()
    others = np.array([0, 1, 10, 100, 10_000, 10_000_000])
    depths = forest.depths(others)
    assert depths[0] == depth and list(depths) == sorted(depths, reverse=True) and depths[-1] < depths[0]
    for n, d in zip(others, depths):
        assert d == 1 or n / 0.8 ** forest.longest * (1 - 0.8 ** d) ** forest.trees <= forest.lost


def shortened(rows, forest):
    """Brute force: the length of each row's prefix, the texts under it, from (tree, run) rows."""
    depth = []
    for tree, run in rows:
        found = forest.depth()
        for t, r in rows:
            if t == tree:
                others = sum(x == (t, r) for x in rows) - 1
                d = int(forest.depths(np.array([others]))[0])
                if d < found and r[:d] == run[:d]:
                    found = d
        depth.append(found)
    return depth


def test_trie_nodes_against_brute_force():
    rng = random.Random(3)
    forest = replace(ngram_join.Forest(), longest=6, recall=0.99, trees=12)
    rows = []
    for tree in (0, 1):
        for _ in range(40):
            run = [rng.randint(0, 2) for _ in range(6)]
            rows += [(tree, tuple(run))] * rng.choice([1, 1, 1, 2, 30])
    rows.sort()
    depth, first, _ = ngram_join.trie_nodes(np.array([t for t, _ in rows]), np.array([r for _, r in rows], dtype=">u2"), forest)
    want = shortened(rows, forest)
    assert list(depth) == want and len(set(want)) > 1
    for at, d in enumerate(want):
        assert first[at] == next(i for i, (t, r) in enumerate(rows) if (t, r[:d]) == (rows[at][0], rows[at][1][:d]))


def test_a_cut_tree_finds_what_a_whole_tree_finds(spark):
    """Every pair that shares the prefix of full recall in some tree hangs together, however ranges cut the trees."""
    rng = np.random.default_rng(4)
    forest = replace(ngram_join.Forest(), trees=4)
    near = rng.integers(0, 5, (6, 4, 8)).astype(">u2")
    rows = []
    for i in range(300):
        run = near[i % 6].copy() if i % 3 else rng.integers(0, 3, (4, 8)).astype(">u2")
        run[rng.integers(0, 4), rng.integers(0, 8)] = rng.integers(0, 9)
        rows.append((i.to_bytes(2, "big"), run.tobytes()))
    signed = spark.createDataFrame([*rows, (b"none", None)], "key binary, runs binary")
    met = set()
    for a, x in rows:
        for b, y in rows:
            if a < b and any(x[16 * t:16 * t + 2 * forest.depth()] == y[16 * t:16 * t + 2 * forest.depth()] for t in range(4)):
                met.add((a, b))
    for size in (10 ** 6, 90):
        edges = ngram_join.candidate_edges(signed, replace(forest, rows=size))
        root = {bytes(r["node"]): bytes(r["root"]) for r in ngram_join.connected_components(edges).collect()}
        assert met and all(root[a] == root[b] for a, b in met) and b"none" not in root
    assert ngram_join.candidate_edges(signed.limit(0), forest).count() == 0


def test_places_and_tokens_of_packed_documents(spark):
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(10)
    texts = [" ".join(rng.choice(["the", "Über", "don't", "x1", "\n\na", "  b", "<|endoftext|>"]) for _ in range(rng.randint(0, 90))) for _ in range(150)]
    texts += [None, "", " ", "a ", " a", "a  b", "tab\t x", "word " * 3000, texts[0]]
    rows = [*enumerate(texts), (0, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("offset", F.lit("clash"))
    pieces = packing.tokenized_pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                                      added=packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))
    placed = packing.place_pieces(pieces).collect()
    want = sorted((i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows)
    by_doc = {}
    for r in placed:
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], np.frombuffer(r["ids"], "<u4").tolist()))
    for i, ids in want:
        mine = sorted(by_doc[i])
        mine = mine[::2] if i == 0 else mine
        assert [x for p in mine for x in p[3]] == ids and all(p[2] == 1024 for p in mine[1:])
        assert [p[1] for p in mine] == [sum(q[2] for q in mine[:k]) for k in range(len(mine))]
    places = {}
    for r in placed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in places.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= 1024
    least = -(-sum(r["length"] for r in placed) // 1024)
    assert len(places) <= least + 1
    whole = packing.packed_sequences(packing.place_pieces(pieces)).agg(F.sum(F.length("ids"))).first()[0]
    assert whole == 4 * sum(r["length"] for r in placed)
    assert packing.place_pieces(pieces.limit(0)).count() == 0


def test_the_genetic_algorithm_keeps_every_document_and_improves():
    counts = np.bincount(np.random.default_rng(2).integers(300, 700, 4000), minlength=1025)
    start = packing.pack_lengths(counts, 1024)
    best = packing.evolve(counts, [start] + [packing.pack_lengths(counts, 1024, np.random.default_rng(k)) for k in range(4)], 1024, 10, 1)[0]
    for genome in (start, best):
        made = np.zeros_like(counts)
        for times, pattern in genome:
            assert packing.filled(pattern) <= 1024
            for size, k in pattern.items():
                made[size] += times * k
        assert (made == counts).all()
    assert packing.fitness(best, 1024) >= packing.fitness(start, 1024)
