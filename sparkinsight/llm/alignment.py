"""Cross-tokenizer alignment: groups of tokens of two tokenizers that cover the same bytes.

Both tokenizers cut the same bytes (a space and the text), so a text is aligned by its two
lists of token ends.  The shorter list gallops through the longer: from the place of an
earlier end it doubles its stride until it has passed the end looked for, then halves the
bracket.  The common ends cut the text into groups; the differences of their ranks in the
two lists say how many tokens of each side a group has.  The last tokens of a group end
together: they are linked, and links are counted by id pair over the whole corpus.

Of two tokens that end together the shorter is a suffix of the longer, so the vocabularies
alone fix which id pairs can ever be linked (``end_pairs``).  That bounds what is counted
in a task and what is broadcast, however large the corpus is.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import bytes_of, worker_store
from .hashing import chunks, decompressor

U4 = np.dtype("<u4")


def gallop(short: np.ndarray, long: np.ndarray, run: int = 4) -> np.ndarray:
    """For every number of ``short`` the first place in ``long`` that is not less (both sorted).

    Every ``run``-th number is placed first (by the same search); the others start
    from the place of the one before them, so strides stay short.
    """
    n, top = len(short), len(long)
    if n <= run:
        at = np.zeros(n, np.int64)
    else:
        at = np.repeat(gallop(short[::run], long, run), run)[:n]
    # exponential phase: lo is known to be less than the number (or the start), hi not
    lo, stride = at - 1, 1
    hi = np.full(n, top, np.int64)
    todo = np.arange(n)
    while len(todo):
        probe = np.minimum(lo[todo] + stride, top)
        inside = probe < top
        past = ~inside
        past[inside] = long[probe[inside]] >= short[todo[inside]]
        hi[todo[past]] = probe[past]
        todo, probe = todo[~past], probe[~past]
        lo[todo] = probe
        stride *= 2
    # binary phase
    todo = np.flatnonzero(hi - lo > 1)
    while len(todo):
        mid = (lo[todo] + hi[todo]) >> 1
        past = long[mid] >= short[todo]
        hi[todo[past]], lo[todo[~past]] = mid[past], mid[~past]
        todo = todo[hi[todo] - lo[todo] > 1]
    return hi


def common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the numbers that two strictly increasing lists share."""
    if len(a) > len(b):
        rb, ra = common(b, a)
        return ra, rb
    at = gallop(a, b)
    hit = np.zeros(len(a), bool)
    inside = at < len(b)
    hit[inside] = b[at[inside]] == a[inside]
    return np.flatnonzero(hit), at[hit]


def end_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sorted codes (id of A << 32 | id of B) of all pairs where one token is a suffix of the other."""
    of_a, of_b = {}, {}
    for table, tokens in ((of_a, a), (of_b, b)):
        for i, t in enumerate(tokens):
            if t:
                table.setdefault(t, []).append(i)
    out = [(i << 32) | j for t, ids in of_a.items() for k in range(len(t)) for j in of_b.get(t[k:], ()) for i in ids]
    out += [(i << 32) | j for t, ids in of_b.items() for k in range(1, len(t)) for i in of_a.get(t[k:], ()) for j in ids]
    return np.array(sorted(out), np.int64)


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: visible Latin-1 stands for itself, the rest follows from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in set(own)]
    return {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(rest)}


class Tokenizers:
    """Two tokenizers, the bytes of their tokens, and the ids of word segments seen before.

    A (byte-level BPE, ``tokenizers`` JSON) reads space and text; B (``sentencepiece``)
    adds the space itself.  Neither joins a character to a space behind it: A's pattern
    starts a new part there, and no piece of B holds a space behind another character
    (else texts are encoded whole).  So segments that start at such a space have their own
    ids, which are kept in two flat arrays; beyond ``limit`` segments those that fewer
    chunks of texts held are forgotten, and so is any longer than ``longest`` characters.
    """

    def __init__(self, a: bytes, b: bytes, limit: int = 600_000, longest: int = 80):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a, self.b = Tokenizer.from_str(a.decode("utf-8")), SentencePieceProcessor(model_proto=b)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        for t, i in vocab.items():
            if t not in special:
                self.a_bytes[i] = bytes(letters[c] for c in t)
        size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        self.b_bytes = [b"" if self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i)
                        else bytes([int(p[3:5], 16)]) if self.b.is_byte(i)
                        else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.parted = not any("▁" in p.lstrip("▁") for p in pieces)
        self.space = self.b.piece_to_id("▁")
        self.limit, self.longest, self.known = limit, longest, {}
        # by number of the segment: its ids' place and number on each side (-1: bytes not kept), chunks that held it
        self.flat = [np.zeros(0, U4), np.zeros(0, U4)]
        self.at, self.size = np.zeros((2, 0), np.int64), np.zeros((2, 0), np.int64)
        self.held = np.zeros(0, np.int64)
        # digits of an id and what follows: inside a side, at the end of a side
        self.marks = ([x for i in range(len(self.a_bytes)) for x in (b"%d," % i, b"%d|" % i)]
                      + [x for i in range(size) for x in (b"%d," % i, b"%d;" % i)])

    # a space behind white space starts no segment (U+180E: white space in older tables)
    _GAP = re.compile("[\\s\u180e] ")
    _CUT = re.compile("(?<=[^\\s\u180e])(?= )")

    def segments(self, text: str) -> list[str]:
        """Space and text cut before every space behind another character, each without its first space."""
        full = " " + text
        if not self.parted:
            return [text]
        return [s[1:] for s in self._CUT.split(full)] if self._GAP.search(full) else text.split(" ")

    def _one(self, text: str) -> tuple[bytes, bytes] | None:
        """Ids of space and text on both sides; None where a side's bytes differ from the text's."""
        full = (" " + text).encode()
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text, num_threads=1) if text else [self.space]
        if b"".join([self.a_bytes[i] for i in a]) != full or b"".join([self.b_bytes[i] for i in b]) != full:
            return None
        return np.array(a, U4).tobytes(), np.array(b, U4).tobytes()

    def _lines(self, segments: list[str], out: list) -> None:
        """Ids of many segments, taken from one text of them all; they part at their known ends."""
        both = self._one(" ".join(segments))
        sizes = np.cumsum([len(s.encode()) + 1 for s in segments])
        cuts = []
        for ids, lens in zip(both or (), (self.a_len, self.b_len)):
            ends = np.cumsum(lens[np.frombuffer(ids, U4)])
            at = np.searchsorted(ends, sizes)
            if (ends[at] == sizes).all():
                cuts.append(np.diff(at, prepend=-1))
        if len(cuts) == 2:
            out.append((segments, *both, *cuts))
        else:
            out += [self._alone(s, s) for s in segments]

    def _alone(self, name: str, text: str) -> tuple:
        got = self._one(text)
        return ([name], b"", b"", [-1], [-1]) if got is None else ([name], *got, [len(got[0]) // 4], [len(got[1]) // 4])

    def _add(self, learnt: list) -> None:
        """Append (names, ids of A, ids of B, their numbers by name) to the store; None names nothing."""
        if not learnt:
            return
        first = len(self.held)
        for k, name in enumerate(n for x in learnt for n in x[0]):
            if name is not None:
                self.known[name] = first + k
        sizes = np.array([np.concatenate([x[3 + side] for x in learnt]) for side in (0, 1)], np.int64)
        taken = np.maximum(sizes, 0)
        starts = np.cumsum(taken, axis=1) - taken + [[len(f)] for f in self.flat]
        self.flat = [np.concatenate([f, np.frombuffer(b"".join(x[1 + side] for x in learnt), U4)]) for side, f in enumerate(self.flat)]
        self.at, self.size = np.concatenate([self.at, starts], axis=1), np.concatenate([self.size, sizes], axis=1)
        self.held = np.concatenate([self.held, np.zeros(sizes.shape[1], np.int64)])

    def _taken(self, idx: np.ndarray, side: int) -> np.ndarray:
        """The ids of the segments ``idx`` in a row."""
        n = np.maximum(self.size[side][idx], 0)
        return self.flat[side][np.repeat(self.at[side][idx] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def _forget(self) -> None:
        """Keep the half of the limit that most chunks held."""
        names = np.array(list(self.known), object)
        idx = np.fromiter(self.known.values(), np.int64, len(names))
        keep = np.argsort(-self.held[idx], kind="stable")[:self.limit // 2]
        names, idx = names[keep], idx[keep]
        self.flat, size = [self._taken(idx, side) for side in (0, 1)], self.size[:, idx]
        taken = np.maximum(size, 0)
        self.at, self.size, self.held = np.cumsum(taken, axis=1) - taken, size, self.held[idx] // 2
        self.known = dict(zip(names.tolist(), range(len(names))))

    def learn(self, segments: set[str]) -> None:
        if len(self.known) > self.limit or len(self.flat[0]) > 16 * self.limit:
            self._forget()
        new = [s for s in segments if s not in self.known]
        plain = [s for s in new if s and len(s) <= self.longest and not s[-1].isspace() and s[-1] != "\u180e"]
        learnt, taken = [], set(plain)
        for k in range(0, len(plain), 400):
            self._lines(plain[k:k + 400], learnt)
        learnt += [self._alone(s, s) for s in new if s not in taken]
        self._add(learnt)

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For both sides the ids of all texts in a row, and their number by text (0: no tokens)."""
        plain, cut = [], []
        for t in texts:
            try:
                plain.append(t.decode("utf-8"))
            except UnicodeDecodeError:
                plain.append("")
            cut.append(self.segments(plain[-1]) if plain[-1] else [])
        self.learn(set().union(*cut) if cut else set())
        n = np.array([len(c) for c in cut], np.int64)
        idx = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(n.sum()))
        bad = self.size[0][idx] < 0
        if bad.any():  # a segment whose bytes are not kept: the text as a whole decides
            of, base = np.repeat(np.arange(len(n)), n), len(self.held)
            whole = np.unique(of[bad])
            self._add([self._alone(None, plain[d]) for d in whole.tolist()])
            rest = ~np.isin(of, whole)
            idx, of = np.concatenate([idx[rest], base + np.arange(len(whole))]), np.concatenate([of[rest], whole])
            order = np.argsort(of, kind="stable")
            idx, n = idx[order], np.bincount(of, minlength=len(n))
        self.held[np.unique(idx)] += 1
        to = np.cumsum(n)
        out = []
        for side in (0, 1):
            ends = np.concatenate([[0], np.cumsum(np.maximum(self.size[side][idx], 0))])
            out.append((self._taken(idx, side).astype(np.int64), ends[to] - ends[to - n]))
        for s in {s for c in cut for s in c if len(s) > self.longest}:
            del self.known[s]
        return out


class Aligned:
    """Alignment of some texts: ids in a row, and per text its ranges of tokens and groups."""

    def __init__(self, tok: Tokenizers, texts: list[bytes]):
        self.tok = tok
        (self.a, self.n_a), (self.b, self.n_b) = tok.encode(texts)
        ends = np.cumsum(tok.a_len[self.a])
        # texts follow each other, so the end of each is a common end of both lists
        self.rank_a, self.rank_b = common(ends, np.cumsum(tok.b_len[self.b]))
        self.group_to = np.searchsorted(self.rank_a, np.cumsum(self.n_a))
        self.n_groups = np.diff(self.group_to, prepend=0)

    def links(self) -> np.ndarray:
        """Codes (id of A << 32 | id of B) of the tokens that end together."""
        return (self.a[self.rank_a] << 32) | self.b[self.rank_b]

    def group_texts(self) -> list[bytes]:
        """Per text ``a1,a2|b1;a3|b2,b3``: the ids of its groups."""
        in_a, in_b = np.diff(self.rank_a, prepend=-1), np.diff(self.rank_b, prepend=-1)
        row = np.empty(len(self.a) + len(self.b), np.int64)
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[self.rank_a] = last_b[self.rank_b] = 1
        row[np.arange(len(self.a)) + np.repeat(self.rank_b + 1 - in_b, in_a)] = 2 * self.a + last_a
        row[np.arange(len(self.b)) + np.repeat(self.rank_a + 1, in_b)] = 2 * (len(self.tok.a_bytes) + self.b) + last_b
        to = np.cumsum(self.n_a + self.n_b).tolist()
        get = self.tok.marks.__getitem__
        return [b"".join(map(get, row[s:e].tolist()))[:-1] for s, e in zip([0, *to], to)]


def _tokenizers(files) -> Tokenizers:
    """This worker's tokenizers of two broadcast files."""
    return worker_store(("alignment", files.value["key"]), lambda: Tokenizers(*files.value["models"]))


def _ship(spark, path_a: str, path_b: str):
    models = []
    for p in (path_a, path_b):
        with open(p, "rb") as f:
            models.append(f.read())
    return spark.sparkContext.broadcast({"key": hashlib.sha256(b"".join(models)).hexdigest(), "models": models})


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per group: the id, group (from 0), a and b (its token ids), byte_end (in space + text).

    Texts that are null, empty or not kept byte for byte by a tokenizer have no groups.
    Every row is aligned by itself, repeated rows and null ids too; nothing is shuffled.
    """
    files = _ship(docs.sparkSession, path_a, path_b)

    def run(batches):
        tok = _tokenizers(files)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for s, e in chunks(texts, 1 << 20):
                x = Aligned(tok, texts[s:e])
                of = np.repeat(np.arange(e - s), x.n_groups)
                first = np.cumsum(x.n_groups) - x.n_groups
                base = np.cumsum([int(n > 0) * (len(t) + 1) for n, t in zip(x.n_groups, texts[s:e])])
                start = np.concatenate([[0], base[:-1]]) if len(base) else base
                end = np.cumsum(tok.a_len[x.a])[x.rank_a]
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], r + 1]), pa.int32()), pa.array(i, pa.int32()))
                         for r, i in ((x.rank_a, x.a), (x.rank_b, x.b))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s, e - s).take(pa.array(of)), pa.array(np.arange(len(of)) - first[of], pa.int64()),
                     *lists, pa.array(end - start[of], pa.int64())], names=["id", "group", "a", "b", "byte_end"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), bytes_of(text_col).alias("t"))
    out = rows.mapInArrow(run, f"id {kind}, group long, a array<int>, b array<int>, byte_end long")
    return out.withColumnRenamed("id", id_col)


def alignment_report(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link's count is the number of links of its id pair over all documents; it is a
    best link where that is the highest count of its B id (ties included).  Texts that
    are null, empty or not kept byte for byte have zeros and an empty digest.  Every row
    counts, repeated rows and null ids too; an empty table gives no rows.  Texts are
    tokenised once: their links are written as numbers of possible pairs, compressed.
    Counts are summed in tasks first; at most one number per possible pair is shuffled
    by a task, collected and broadcast (``end_pairs``, under a million here).
    """
    spark = docs.sparkSession
    files = _ship(spark, path_a, path_b)
    tok = _tokenizers(files)
    pairs = end_pairs(tok.a_bytes, tok.b_bytes)
    possible = spark.sparkContext.broadcast(pairs)

    def cut(batches):
        import zstandard
        pack = zstandard.ZstdCompressor(level=1).compress
        tok = _tokenizers(files)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for s, e in chunks(texts, 2 << 20):
                x = Aligned(tok, texts[s:e])
                link = np.searchsorted(possible.value, x.links()).astype(U4)
                digest = [hashlib.sha256(g).hexdigest() if g else "" for g in x.group_texts()]
                to = x.group_to.tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s, e - s), pa.array(x.n_a), pa.array(x.n_b), pa.array(x.n_groups), pa.array(digest),
                     pa.array([pack(link[f:t].tobytes()) for f, t in zip([0, *to], to)], pa.binary())],
                    names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bytes_of().alias("t"))
    done = materialize(rows.mapInArrow(
        cut, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"))
    size = len(pairs)

    def tally(batches):
        un, total = decompressor(), np.zeros(size, np.int64)
        for batch in batches:
            for z in batch.column(0).to_pylist():
                np.add.at(total, np.frombuffer(un(z), U4), 1)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["pair", "n"])

    got = done.select("links").mapInArrow(tally, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    count, top = np.zeros(size, np.int64), np.zeros(len(tok.b_bytes), np.int64)
    count[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    of_b = pairs & 0xFFFFFFFF
    np.maximum.at(top, of_b, count)
    counts = spark.sparkContext.broadcast((count, count == top[of_b]))

    def score(batches):
        un = decompressor()
        count, best = counts.value
        for batch in batches:
            links = [np.frombuffer(un(z), U4) for z in batch.column(5).to_pylist()]
            cols = [[len(x) for x in links], [int(best[x].sum()) for x in links], [int(count[x].sum()) for x in links]]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(4)), *(pa.array(c, pa.int64()) for c in cols), batch.column(4)],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return done.mapInArrow(score, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                                  "count_sum long, groups_sha256 string")
