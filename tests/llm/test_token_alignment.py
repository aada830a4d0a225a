"""Alignment of two tokenisations against a plain one over whole texts."""

import random
from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from casegraph.llm import token_alignment
from casegraph.llm.token_alignment import alignments

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ALPHABET = "abct ÀéΣ'se  \n\t<|>.,!12́🙂\x1c　\xa0▁日本"


class Library:
    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.bytes = {chr(b): b for b in shown}
        self.bytes |= {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}

    def groups(self, text):
        """Lists of A and B ids for each group; None if a side does not give the text back."""
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        in_a = [bytes(self.bytes[c] for c in t) if "<|" not in (t := self.a.id_to_token(i)) else t.encode() for i in a]
        in_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [self.b.id_to_piece(i)]]
        if not b"".join(in_a) == b"".join(in_b) == (" " + text).encode():
            return None
        out, at_a, at_b, own_a, own_b = [], 0, 0, [], []
        left = list(zip(b, in_b))
        for i, data in zip(a, in_a):
            own_a.append(i)
            at_a += len(data)
            while left and at_b + len(left[0][1]) <= at_a:
                j, more = left.pop(0)
                own_b.append(j)
                at_b += len(more)
            if at_a == at_b:
                out.append((own_a, own_b))
                own_a, own_b = [], []
        return out


def plain(library, rows):
    found = [library.groups(t) for _, t in rows]
    links = [[(i, j) for a, b in g or () for i in a for j in b] for g in found]
    counts = Counter(p for own in links for p in set(own))
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for (doc_id, _), g, own in zip(rows, found, links):
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or ())
        out.append((
            doc_id, sum(len(a) for a, _ in g or ()), sum(len(b) for _, b in g or ()), len(g or ()), len(own),
            sum(counts[p] == best[p[0]] for p in own), sum(counts[p] for p in own), sha256(shown.encode()).hexdigest() if g else "",
        ))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in alignments(df).collect()), key=str)


@pytest.fixture(scope="module")
def library():
    return Library()


def test_documents(spark, documents, library):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert got(documents) == plain(library, rows)


def random_texts(n):
    rng = random.Random(5)
    words = ["the", "haus", "naïve", "<s>", "<0x41>", "<|endoftext|>", "it's", "12", "…", "日本語", "x" * 50, "zzzzq", "", " ", "\n"]
    for k in range(n):
        if k % 2:
            yield "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40)))
        else:
            yield " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))


def test_random_texts_in_small_runs(spark, library, monkeypatch):
    """All borders of units, blocks and runs; ids of groups as the libraries give them for the whole text."""
    rows = list(enumerate(random_texts(1500)))
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == plain(library, rows)
    monkeypatch.setattr(token_alignment, "RUN_CHARS", 20)
    sheet = token_alignment.Sheet(token_alignment.pair_of("byte_bpe_50k.json", "piece_bpe_32k.model"))
    for i, text in rows:
        sheet.add(i, text)
    numbers, doc, key, times = sheet.finished()
    want = {r[0]: r for r in plain(library, rows)}
    for r in numbers:
        w = want[r[0]]
        assert ((*r[2:6], r[6].hexdigest()) if r[1] else (0, 0, 0, 0, "")) == (*w[1:5], w[7]), rows[r[0]]
    links = Counter()
    for d, k, n in zip(doc.tolist(), key.tolist(), times.tolist()):
        links[d, k >> 20, k & (1 << 20) - 1] += n
    expected = Counter((i, a, b) for i, t in rows for g in [library.groups(t)] for x, y in g or () for a in x for b in y)
    assert links == expected


def test_identity_map(library):
    pair = token_alignment.pair_of("byte_bpe_50k.json", "piece_bpe_32k.model")
    a = library.a.token_to_id("Ġthe")
    assert library.b.id_to_piece(int(pair.same[a])) == "▁the"
    letter = library.a.token_to_id("a")
    assert library.b.id_to_piece(int(pair.same[letter])) == "a"


def test_odd_rows(spark, odd, none, library):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] not in (6,)]
    assert got(odd.where("doc_id is null or doc_id <> 6")) == plain(library, rows)
    assert alignments(odd).count() == odd.count()
    assert alignments(none).count() == 0


def test_empty_and_unreadable_only(spark):
    rows = [(1, None), (2, ""), (3, "a ▁ b")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]
