"""Source divergence, ids as ORC, and alignment of tokenizers, against plain Python."""

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow.orc
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm import alignment, divergence, entry, orc_ids

WORD, BYTE, PIECE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "  a", "a ", "a\n", "\na", "a\n\n  b\tc", "a  b", "x y z", "don't  stop 12345", "日本語 テキスト\n日本", "▁x y", "a ▁ b", "x\r\ny \r z", "é" * 300, "----------" * 40 + " ok", "<|endoftext|> <s> </s>", "\x00 a", "a\x1c b\x85 c", "one two three", "one two three", "lorem ipsum dolor sit amet. " * 4000, "a\n", "\n\n\n", "  b", "🙂 🙂🙂\n🙂"]


def odd_rows(spark):
    rows = [(k if k % 7 else None, t, ("en", "de", None)[k % 3], ("s", "t", None, "")[k % 4]) for k, t in enumerate(ODD)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    return rows, made.withColumns({c: F.lit("clash") for c in ("term", "n", "docs", "part", "ids", "start", "block", "pairs", "salt", "_raw", "_hash", "n_a", "base")})


def diverged_by_hand(rows, min_docs, top):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        groups.add((lang, source))
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    kept = {g[0]: sorted(w for w, n in docs[g[0]].items() if n >= min_docs) for g in groups}
    shares = {}
    for lang in kept:
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update(counts[g])
        for key, c in [((lang, g[1]), counts[g]) for g in groups if g[0] == lang] + [((lang, None), whole)]:
            size = sum(c[w] for w in kept[lang])
            shares[key] = {w: 1 + 10**9 * (c[w] + 5) // (size + 5 * len(kept[lang])) for w in kept[lang]}
    out = []
    for lang, source in groups:
        own = shares[lang, source]
        pairs = [(-sum(abs(own[w] - shares[lang, s][w]) for w in own), s.encode(), s) for x, s in groups if x == lang and s != source]
        words = [(shares[lang, None][w] - own[w], w.encode(), w) for w in own if counts[lang, source][w] and own[w] > shares[lang, None][w]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(words)[:top])):
            out += [(lang, source, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def test_divergence(spark):
    rows, made = odd_rows(spark)
    for min_docs, top in ((1, 50), (2, 3), (99, 50)):
        got = sorted(tuple(r) for r in divergence.divergence(made, min_docs=min_docs, top=top).collect())
        assert got == diverged_by_hand([(lang, source, t) for _, t, lang, source in rows], min_docs, top)
    assert divergence.divergence(made.filter("false")).count() == 0


def test_divergence_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(divergence, "ENTRIES", 3)
    rows, made = odd_rows(spark)
    assert sorted(tuple(r) for r in divergence.divergence(made, min_docs=1).collect()) == diverged_by_hand([(lang, source, t) for _, t, lang, source in rows], 1, 50)


def test_shares_of_large_counts_are_exact(spark):
    n, size, v = 7 * 10**12, 9 * 10**14 + 1, 10**8
    made = spark.range(1).select(divergence.share(F.lit(n), F.lit(size), F.lit(v), 5, 10**9).alias("p")).first()
    assert made["p"] == 1 + 10**9 * (n + 5) // (size + 5 * v)


def encoded_by_hand(rows):
    library = Tokenizer.from_file(WORD)
    return [(i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]


@pytest.mark.parametrize("batch", [1_000_000, 5])
def test_orc(spark, tmp_path, monkeypatch, batch):
    monkeypatch.setattr(orc_ids, "BATCH", batch)
    rows, made = odd_rows(spark)
    folder = orc_ids.write(made, f"file://{tmp_path}/o", WORD)
    wanted = encoded_by_hand([(i, t) for i, t, _, _ in rows])
    stored = orc_ids.with_start(orc_ids.read(spark, folder), spark, folder).collect()
    assert sorted(((r["doc_id"] or -1, r["ids"]) for r in stored), key=str) == sorted(((i or -1, x) for i, x in wanted), key=str)
    stream = sorted(stored, key=lambda r: r["start"])
    assert [r["doc_id"] is not None for r in stream] == sorted(r["doc_id"] is not None for r in stream)
    known = [r["doc_id"] for r in stream if r["doc_id"] is not None]
    assert known == sorted(known)
    at = 0
    for r in stream:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]))
        at += r["n_tokens"]
    digests = sorted(tuple(r[c] for c in ("start", "n_tokens", "ids_crc32")) for r in orc_ids.digests(spark, folder).collect())
    assert digests == [(r["start"], r["n_tokens"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in stream]
    found = orc_ids.lookup(spark, folder, [5, 8])
    assert sorted(r["doc_id"] for r in found.collect()) == [5, 8] and "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()


def test_orc_stripes_and_bloom_filters(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(orc_ids, "STRIPE", 1 << 14)
    rows = [(3 * k, f"word{k} other {k * k}") for k in range(30_000)]
    folder = orc_ids.write(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/o", WORD)
    files = sorted((tmp_path / "o" / "ids").glob("part-*"))
    assert sum(pyarrow.orc.ORCFile(str(f)).nstripes for f in files) > len(files)
    assert sum(pyarrow.orc.ORCFile(str(f)).nrows for f in files) == len(rows)
    # ids between the least and the greatest that are not there are ruled out by statistics and filters alone
    assert orc_ids.lookup(spark, folder, [3 * 777 + 1]).count() == 0 and orc_ids.lookup(spark, folder, [3 * 777]).count() == 1
    assert orc_ids.parts(spark, folder).agg(F.sum("n_docs")).first()[0] == len(rows)
    empty = orc_ids.write(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/e", WORD)
    assert orc_ids.digests(spark, empty).count() == 0
    with pytest.raises(ValueError, match="own"):
        orc_ids.write(spark.createDataFrame([], "part long, text string"), f"file://{tmp_path}/f", WORD, id_col="part")


def aligned_by_hand(texts):
    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}
    docs, counts = [], Counter()
    for text in texts:
        groups = []
        if text:
            raw, x, y = (" " + text).encode(), a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            of_x = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
            of_y = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p := b.id_to_piece(i)) else p.replace("▁", " ").encode() for i in y]
            if b"".join(of_x) == raw == b"".join(of_y):
                ends = [list(np.cumsum([len(t) for t in of]).tolist()) for of in (of_x, of_y)]
                shared = sorted(set(ends[0]) & set(ends[1]))
                parts = [([], []) for _ in shared]
                for side, (ids, at) in enumerate(((x, ends[0]), (y, ends[1]))):
                    for i, e in zip(ids, at, strict=True):
                        parts[bisect_left(shared, e)][side].append(i)
                groups = parts
        links = Counter((i, j) for p, q in groups for i in p for j in q)
        counts.update(set(links))
        docs.append((groups, links))
    best = Counter()
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    out = []
    for groups, links in docs:
        text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        sums = sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), sum(links.values())
        out.append((*sums, sum(n for k, n in links.items() if counts[k] == best[k[0]]), sum(n * counts[k] for k, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("block", [2_000_000, 50])
def test_alignment(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    rows, made = odd_rows(spark)
    got = [tuple(r[n] for n in NAMES) for r in alignment.align(made, BYTE, PIECE).collect()]
    assert sorted(got) == sorted(aligned_by_hand([t for _, t, _, _ in rows]))
    assert alignment.align(made.filter("false"), BYTE, PIECE).count() == 0


def test_queries_on_a_small_table(spark):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet").sort_values("doc_id")
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in entry.op13_token_alignment(spark, SMALL).collect()}
    assert got == dict(zip(docs["doc_id"], aligned_by_hand(docs["text"]), strict=True))
    at, wanted = 0, []
    for i, ids in encoded_by_hand(zip(docs["doc_id"], docs["text"], strict=True)):
        wanted.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in entry.op12_orc_ids(spark, SMALL).collect()) == wanted
