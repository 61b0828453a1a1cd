"""Sum-of-squares online packing of token streams into windows.

Each task packs the documents of its own scan partition as they come, so
no text is shuffled. A document's tokens beyond whole windows fill windows
of their own; the rest is one item, put into the fill level that makes the
sum over levels of (number of open windows at that level)^2 smallest. The
level array holds those counts; full windows leave at once. At the end of
a partition (or when ``max_open`` windows are open, which bounds memory)
the open windows are topped up from each other by cutting pieces, and the
one window left over is cut at powers of two, so nothing is padded.

Edge cases: a null or empty text is one end token; documents with the same
id or text are packed each; an empty table gives no rows. ``tokenizer``
is the path of a vocabulary file that every executor can read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import textvec as tv

END = 1
#: Words whose ids a Python worker keeps; beyond it starts anew.
CACHE_WORDS = 600_000
_cache: dict[str, Encoder] = {}

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, ids binary")


#: Words that are normalised and split as one text.
CALL_WORDS = 512


class Encoder:
    """Texts to ids. No token of these
    vocabularies holds white space, so runs between ASCII white space are
    encoded by themselves and remembered, within a bound.

    New words of a batch of documents go through the vocabulary's own
    stages: its normaliser and its splitter, many words as one text, then
    its model, once per distinct piece. For words of visible ASCII signs
    the first two amount to lower case and the splitter's pattern, if the
    vocabulary is of that kind. Words that hold an added token are encoded
    as they are."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.pattern = _ascii_pattern(json.loads(self.tok.to_str()))
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column of texts, one after the other, and where each
        text's begin (and the last end); a null counts as empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) + len(words) > CACHE_WORDS:
            self.known.clear()
            self.pieces.clear()
        new = [w for w in words if w not in self.known]
        if new:
            self._learn(new)
        ids = [self.known[w] for w in words]
        size = np.array([len(x) // 4 for x in ids], np.int64)
        first = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(ids), "<u4")
        at = coded.indices.to_numpy()
        n = size[at]
        ends = np.cumsum(n)
        out = flat[np.repeat(first[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.r_[0, ends][split.offsets.to_numpy() - split.offsets[0].as_py()]
        return out, bounds

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.pieces[piece] = np.array([t.id for t in self.tok.model.tokenize(piece)], "<u4").tobytes()
        return ids

    def _learn(self, words: list[str]) -> None:
        rest, whole, known = words, [], self.known
        text = " ".join(words)
        if any(x in text for x in self.added):
            whole = [w for w in words if any(x in w for x in self.added)]
            rest = sorted(set(words).difference(whole))
        if self.pattern:
            piece, find = self._piece, self.pattern.findall
            for w in rest:
                if w.isascii() and w.isprintable():
                    known[w] = b"".join(map(piece, find(w.lower())))
            rest = [w for w in rest if w not in known]
        for k in range(0, len(rest), CALL_WORDS):
            part = rest[k:k + CALL_WORDS]
            text = " ".join(part)
            if self.tok.normalizer is not None:
                text = self.tok.normalizer.normalize_str(text)
            normal = text.split(" ")
            if len(normal) != len(part) or self.tok.pre_tokenizer is None:
                whole += part                                   # other white space within a word
                continue
            own: list[list[bytes]] = [[] for _ in part]
            ends = np.cumsum([len(t) + 1 for t in normal])
            found = self.tok.pre_tokenizer.pre_tokenize_str(text)
            for i, (piece, _) in zip(np.searchsorted(ends, [at[0] for _, at in found], "right").tolist(), found):
                own[i].append(self._piece(piece))
            for w, ids in zip(part, own):
                known[w] = b"".join(ids)
        for w, e in zip(whole, self.tok.encode_batch_fast(whole, add_special_tokens=False)):
            known[w] = np.array(e.ids, "<u4").tobytes()


def _ascii_pattern(config: dict):
    """The splitter's pattern, if normalising leaves visible ASCII signs but
    for their case, and nothing else splits or maps them; else None."""
    stages = lambda c, many: [] if c is None else c[many] if c["type"] == "Sequence" else [c]
    normal = stages(config["normalizer"], "normalizers")
    split = stages(config["pre_tokenizer"], "pretokenizers")
    plain = all(n["type"] in ("NFC", "Lowercase") or (n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"}) for n in normal)
    if not plain or not any(n["type"] == "Lowercase" for n in normal) or [x["type"] for x in split] != ["Split", "ByteLevel"]:
        return None
    first, second = split
    if (first["behavior"], first["invert"], "Regex" in first["pattern"]) != ("Removed", True, True):
        return None
    if second["add_prefix_space"] or second["use_regex"]:
        return None
    import regex
    return regex.compile(first["pattern"]["Regex"])


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary."""
    if path not in _cache:
        _cache[path] = Encoder(path)
    return _cache[path]


class LevelPacker:
    """Windows of one partition. ``add`` yields finished windows: lists of
    (doc, start, ids bytes, doc_tokens)."""

    def __init__(self, size: int, max_open: int = 2048):
        self.size, self.max_open = size, max_open
        self.count = np.zeros(size + 1, np.int64)      # the level array
        self.open: dict[int, list[list]] = {}
        self.n_open = 0

    def level_for(self, n: int) -> int:
        """Level (0: a new window) for an item of n < size tokens."""
        c = self.count
        # change of the sum of squares when one window moves h -> h + n
        rise = 2 * c[n:self.size] + 1                  # to h + n, h = 0 .. size-n-1
        delta = np.empty(self.size - n + 1, np.int64)
        delta[:-1] = rise
        delta[-1] = 0                                  # a full window leaves
        delta[1:] -= 2 * c[1:self.size - n + 1] - 1    # from h; none from a new one
        able = c[:self.size - n + 1] > 0
        able[0] = True
        delta[~able] = np.iinfo(np.int64).max
        best = delta.min()
        return int(np.flatnonzero(delta == best)[-1])  # ties to the fullest

    def add(self, doc, ids: bytes) -> Iterator[list]:
        total = len(ids) // 4
        whole = total - total % self.size
        for s in range(0, whole, self.size):
            yield [(doc, s, ids[4 * s:4 * (s + self.size)], total)]
        n = total - whole
        if not n:
            return
        item = (doc, whole, ids[4 * whole:], total)
        h = self.level_for(n)
        if h:
            window = self.open[h].pop()
            self.count[h] -= 1
            self.n_open -= 1
        else:
            window = []
        window.append(item)
        if h + n == self.size:
            yield window
            return
        self.open.setdefault(h + n, []).append(window)
        self.count[h + n] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            yield from self.flush()

    def flush(self) -> Iterator[list]:
        """Fill the fullest open windows with pieces of the emptiest; cut
        the last one at powers of two."""
        rest = [(h, w) for h in sorted(self.open) for w in self.open[h]]
        self.open, self.n_open = {}, 0
        self.count[:] = 0
        pool: list[tuple] = []                         # pieces of dismantled windows
        while rest or pool:
            if rest:
                level, window = rest.pop()
            else:
                level, window = 0, []
            while level < self.size and (pool or rest):
                if not pool:
                    pool = rest.pop(0)[1][::-1]
                doc, s, ids, total = pool.pop()
                take = min(self.size - level, len(ids) // 4)
                window.append((doc, s, ids[:4 * take], total))
                level += take
                if 4 * take < len(ids):
                    pool.append((doc, s + take, ids[4 * take:], total))
            if level == self.size:
                yield window
                continue
            while window:                              # the last: powers of two
                part = 1 << (level.bit_length() - 1)
                level -= part
                cut = []
                while part:
                    doc, s, ids, total = window.pop(0)
                    take = min(part, len(ids) // 4)
                    cut.append((doc, s, ids[:4 * take], total))
                    part -= take
                    if 4 * take < len(ids):
                        window.insert(0, (doc, s + take, ids[4 * take:], total))
                yield cut


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and ids (little-endian 32-bit) if asked for."""
    def run(batches):
        from pyspark import TaskContext
        seq = TaskContext.get().partitionId() << 40
        encode, packer = encoder(tokenizer), LevelPacker(size)
        end = np.array([END], "<u4").tobytes()
        rows: list[tuple] = []

        def put(window):
            nonlocal seq
            at = 0
            for doc, s, ids, total in window:
                n = len(ids) // 4
                rows.append((doc, s, n, zlib.crc32(ids), total, seq, at, ids if with_ids else None))
                at += n
            seq += 1

        def out():
            cols = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(cols[7], pa.binary())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        for b in batches:
            ids, at = encode(b.column(1))
            for doc, s, e in zip(b.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                for window in packer.add(doc, ids[s:e].tobytes() + end):
                    put(window)
                if len(rows) >= 2000:
                    yield out()
        for window in packer.flush():
            put(window)
        if rows:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
               .mapInArrow(tv.tidy(run), SCHEMA)
