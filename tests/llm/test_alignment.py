"""Alignment of two tokenizers against loops over all pairs of tokens of every text."""

import collections
import hashlib

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.test_operators import SCHEMA, TEXTS, prose
from tidemark.llm import alignment, queries
from tidemark.llm.packing import vocabulary_path

CASES = [
    *[t for t in TEXTS if t is None or len(t) < 4000], "The quick brown fox, naïve café — 12345 tokens!", " lead", "trail ", "two  spaces\n\nlines\ttab", "<|endoftext|> and <s> </s> <unk> <0x41>",
    "Ġ byte forms Ċ", "under▁score", "ﬁ ligature ①", "𝔘𝔫𝔦 😀😀 日本", " x", "\x00nul", "aaaaaaaaaaaaaaaaaaaa " * 3, "a", "é", "é", "don't can't it's", "The " * 40,
]


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))


def plain_tokens(tools, text):
    """(id, first byte, end) of both sides, or none where the bytes differ; A's bytes come from its own decoder of single letters."""
    a, b = tools
    if not text:
        return [], []
    shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    table = {c: chr(c) for c in shown} | {c: chr(256 + k) for k, c in enumerate(x for x in range(256) if x not in shown)}
    back = {v: k for k, v in table.items()}
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    raw_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
    if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
        return [], []
    out = []
    for ids, raw in ((ids_a, raw_a), (ids_b, raw_b)):
        at, side = 0, []
        for i, x in zip(ids, raw):
            side.append((i, at, at + len(x)))
            at += len(x)
        out.append(side)
    return out


def plain_align(tools, rows):
    per, held = [], collections.Counter()
    for doc_id, text in rows:
        a, b = plain_tokens(tools, text)
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for i, s, e in a if low < e <= c) + "|" + ",".join(str(i) for i, s, e in b if low < e <= c))
            low = c
        per.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
        held.update(set(links))
    best = collections.defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    return collections.Counter((d, x, y, g, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), sha) for d, x, y, g, links, sha in per)


def test_query_against_loops(spark, tools, tmp_path):
    rows = list(enumerate(CASES)) + [(3, CASES[3]), (None, "no id The quick"), (None, None), (2**60, prose(60, 4)), (-5, "Ünïcode naïve")]
    df = spark.createDataFrame([(i, t, "en", "s", 0, 1) for i, t in rows], SCHEMA + ", `row` int").repartition(3)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    want = plain_align(tools, rows)
    assert collections.Counter(tuple(r) for r in queries.op13_tokenizer_alignment(spark, str(tmp_path)).collect()) == want
    for hot in (1, 3, 40):  # all, nearly all, some pairs go by the shuffle
        assert collections.Counter(tuple(r) for r in alignment.align(df, hot=hot).collect()) == want
    assert sum(n for r, n in want.items() if r[1] == 0) >= 4  # null, empty and texts that B changes


def test_identity_map(tools):
    a, b = tools
    one = alignment.aligner(vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))
    kept = [i for i in range(len(one.same)) if one.same[i] >= 0]
    assert len(kept) > 5000 and all(one.bytes_a[i] == one.bytes_b[one.same[i]] for i in kept)
    missing = set(range(len(one.same))) - set(kept)
    assert not {one.bytes_a[i] for i in missing} & {x for x in one.bytes_b if x} or all(one.bytes_a[i] == b"" for i in missing)


def test_long_text_and_empty_table(spark, tools):
    text = prose(60_000, 8)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = alignment.align(df).first()
    # every word is " w" and digits on both sides, so a word's tokens never reach into the next
    a, b = plain_tokens(tools, prose(1000, 8))
    assert r.n_links == r.n_a + r.n_b - r.n_groups and r.n_groups >= 60_000 and r.count_sum == r.n_links
    assert len(a) > 1000 and alignment.align(df.limit(0)).collect() == []
