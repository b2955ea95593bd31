"""SentencePiece encoding and decoding (BPE with byte fallback) by vectorised merge rounds.

The words that a block of texts needs lie in flat numpy arrays of symbols. A round takes the smallest pair rank of
every word (a segmented minimum), merges all its leftmost occurrences at once, closes the gaps and looks up the
ranks of the new pairs, until no word has a pair left. Ids are those of the sentencepiece library; texts are
processed whole, in Arrow batches, without a shuffle.

Edge cases: null and empty texts give the begin and end ids alone and decode to the empty text; every row gives a row
(repeated and null ids too); invalid UTF-8 bytes count as U+FFFD each; a text without spaces is cut only where no
piece of the vocabulary holds both neighbours, so memory stays bounded and the ids stay those of the whole text.
Columns of ``docs`` other than the id and the text are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest model file that is sent to the workers.
MAX_MODEL_BYTES = 64 << 20
#: Characters of words that are merged together; a word beyond is cut where that changes nothing.
BLOCK_CHARS = 1 << 19
#: Rows of a batch that are worked on at a time.
SLICE = 256
#: A worker remembers the ids of so many words of up to so many characters (some 50 MB).
WORDS, WORD_CHARS = 250_000, 48
SPACE = "▁"
#: Symbols of a word from which merges that must go one by one are made with a heap.
HEAP_SIZE = 64
_NONE = np.int32(2**31 - 1)

codecs.register_error("graphloom_each_byte", lambda e: ("�", e.start + 1))


class PieceModel:
    """A vocabulary with its pair ranks; ``encode`` gives ids as little-endian unsigned 32-bit integers."""

    def __init__(self, proto: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) for i in range(n)]
        if any(sp.is_unused(i) for i in range(n)) or not any(sp.is_byte(i) for i in range(n)) or sp.normalize("ﬁ x  ") != f"{SPACE}ﬁ{SPACE}x{SPACE}{SPACE}":
            raise ValueError("only byte-fallback models without unused pieces, with a leading space and no further normalisation")
        pieces = {names[i]: i for i in range(n) if plain[i]}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece goes over the start of a word")
        self.bos, self.eos = (np.array([x], "<u4").tobytes() for x in (sp.bos_id(), sp.eos_id()))
        byte_of = {i: int(names[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self._byte_ids = np.zeros(256, "<u4")
        for i, b in byte_of.items():
            self._byte_ids[b] = i
        # what an id decodes to
        self._bytes = [bytes([byte_of[i]]) if i in byte_of else names[i].replace(SPACE, " ").encode() if plain[i] else " ⁇ ".encode() if sp.is_unknown(i) else b"" for i in range(n)]
        # symbols: the pieces, and after them characters that stand in pieces without being one
        symbols = dict(pieces)
        for p in pieces:
            for c in p:
                symbols.setdefault(c, n + len(symbols))
        self._n, self._m = n, n + len(symbols) + 1
        self._symbol, self._code = np.full(0x110000, -1, np.int64), np.zeros(self._m - n, np.int64)
        for s, i in symbols.items():
            if len(s) == 1:
                self._symbol[ord(s)] = i
            if i >= n:
                self._code[i - n] = ord(s)
        scores = {p: sp.get_score(i) for p, i in pieces.items()}
        rank = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self._near, found, careful = set(), [], set()
        for p, i in pieces.items():
            self._near.update(p[j : j + 2] for j in range(len(p) - 1))
            for j in range(1, len(p)):
                x, y = p[:j], p[j:]
                if x in symbols and y in symbols:
                    found.append((symbols[x] * self._m + symbols[y], rank[scores[p]], i))
                # a merge that can bring forth a pair of no later rank must not be made everywhere at once
                careful.update(q for q in (x, y) if q in scores and len(q) > 1 and scores[p] >= scores[q])
        found.sort()
        near = np.array(sorted(ord(p[0]) << 21 | ord(p[1]) for p in self._near), np.int64)
        self._near_codes = near if len(near) else np.array([-1], np.int64)
        self._split = self._splitter()
        self._keys = np.array([f[0] for f in found], np.int64)
        self._ranks, self._made = np.array([f[1] for f in found], np.int32), np.array([f[2] for f in found], np.int64)
        self._careful = np.zeros(len(rank) + 1, bool)
        self._careful[[rank[scores[q]] for q in careful]] = True
        self._table = dict(zip(self._keys.tolist(), zip(self._ranks.tolist(), self._made.tolist(), strict=True), strict=True))
        self._known: dict[str, bytes] = {}

    def _splitter(self) -> Callable[[str], list[str]]:
        """Cuts a text into words: runs of letters or of other characters, with the spaces before them; no piece goes over a cut."""
        odd = ""
        while True:
            letter = re.compile(rf"[^\W\d_{SPACE}{re.escape(odd)}]").match
            over = {a if letter(a) else b for a, b in self._near if a != SPACE and bool(letter(a)) != bool(letter(b))}
            if not over:
                break
            odd += "".join(sorted(over))
        o = re.escape(odd)
        other = rf"\W\d_{o}" if odd else r"\W\d_"
        return re.compile(rf"{SPACE}*[^\W\d_{SPACE}{o}]+|{SPACE}*(?:(?!{SPACE})[{other}])+|{SPACE}+").findall

    def _pairs(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of symbol pairs (_NONE: no piece) and the pieces that they make."""
        key = np.where((x >= 0) & (y >= 0), x * self._m + y, -1)
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], _NONE), self._made[at]

    def _by_heap(self, sym: list[int]) -> list[int]:
        """One word, pair by pair: the smallest rank first, of equal ones the leftmost."""
        left, right, alive = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1], [True] * len(sym)
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            key = sym[i] * self._m + sym[j] if sym[i] >= 0 and sym[j] >= 0 else -1
            if key in self._table:
                r, made = self._table[key]
                heapq.heappush(heap, (r, i, j, key, made))

        for i in range(len(sym) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, key, made = heapq.heappop(heap)
            if not (alive[i] and alive[j] and right[i] == j and sym[i] * self._m + sym[j] == key):
                continue
            sym[i], alive[j], right[i] = made, False, right[j]
            if right[i] >= 0:
                left[right[i]] = i
                offer(i, right[i])
            if left[i] >= 0:
                offer(left[i], i)
        return [s for s, a in zip(sym, alive, strict=True) if a]

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word number, symbol) of all words, in order."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        sym = self._symbol[chars]
        # a character that no piece holds keeps its code, as a negative number
        sym = np.where(sym < 0, -1 - chars, sym)
        if not len(sym):
            return np.zeros(0, np.int64), sym
        # within a word, segments end where no piece holds the two characters
        pair = chars[:-1] << 21 | chars[1:]
        at = np.minimum(np.searchsorted(self._near_codes, pair), len(self._near_codes) - 1)
        owner = np.repeat(np.arange(len(words)), lens)
        last = np.append((self._near_codes[at] != pair) | (owner[1:] != owner[:-1]), True)
        word = np.cumsum(np.append(False, last[:-1]))
        owner = owner[last]
        rank, made = self._pairs(sym, np.append(sym[1:], -1))
        rank[last] = _NONE
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(first, len(sym)))
            least = np.minimum.reduceat(rank, first)
            over = least == _NONE
            # words where one merge a round would take too many rounds
            slow = ~over & self._careful[np.where(over, 0, least)] & (size > HEAP_SIZE)
            if over.any() or slow.any():
                for i in np.flatnonzero(slow):
                    got = self._by_heap(sym[first[i] : first[i] + size[i]].tolist())
                    done.append((np.full(len(got), word[first[i]]), np.array(got, np.int64)))
                gone, stay = np.repeat(over, size), np.repeat(~(over | slow), size)
                done.append((word[gone], sym[gone]))
                sym, word, rank, made = sym[stay], word[stay], rank[stay], made[stay]
                least, size = least[~(over | slow)], size[~(over | slow)]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            # of hits that overlap every second one, from the left; of a careful rank the word's first alone
            run = np.append(True, at[1:] != at[:-1] + 1)
            start = at[run][np.cumsum(run) - 1]
            lead = np.append(True, word[at][1:] != word[at][:-1])
            at = at[np.where(self._careful[rank[at]], lead, (at - start) % 2 == 0)]
            sym[at] = made[at]
            alive = np.ones(len(sym), bool)
            alive[at + 1] = False
            to = np.cumsum(alive) - 1
            sym, word, rank, made = sym[alive], word[alive], rank[alive], made[alive]
            new = to[at]
            # the pairs before and after each new piece
            mark = np.zeros(len(sym), bool)
            mark[new] = mark[np.maximum(new - 1, 0)] = True
            look = np.flatnonzero(mark)
            nxt = np.minimum(look + 1, len(sym) - 1)
            r, m = self._pairs(sym[look], sym[nxt])
            r[(nxt == look) | (word[nxt] != word[look])] = _NONE
            rank[look], made[look] = r, m
        word, sym = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(word, kind="stable")
        return owner[word[order]], sym[order]

    def _ids_of(self, words: list[str]) -> Iterator[bytes]:
        """The ids of each word."""
        word, sym = self._merge(words)
        raw = (sym < 0) | (sym >= self._n)
        if raw.any():
            # characters that are no piece become their bytes
            codes = np.where(sym < 0, -1 - sym, self._code[np.where(sym < self._n, self._n, sym) - self._n])[raw].astype("<u4")
            reps = np.ones(len(sym), np.int64)
            reps[raw] = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
            sym, word, raw = np.repeat(sym, reps), np.repeat(word, reps), np.repeat(raw, reps)
            sym[raw] = self._byte_ids[np.frombuffer(codes.tobytes().decode("utf-32-le").encode(), np.uint8)]
        flat = sym.astype("<u4").tobytes()
        ends = 4 * np.searchsorted(word, np.arange(len(words)), side="right")
        lo = 0
        for hi in ends.tolist():
            yield flat[lo:hi]
            lo = hi

    def _cut(self, word: str) -> list[str]:
        """A very long word in parts of at most about BLOCK_CHARS characters, between characters that no piece holds side by side."""
        parts, lo = [], 0
        while len(word) - lo > BLOCK_CHARS:
            hi = lo + BLOCK_CHARS
            while hi > lo and word[hi - 1 : hi + 1] in self._near:
                hi -= 1
            if hi == lo:
                hi = lo + BLOCK_CHARS
                while hi < len(word) and word[hi - 1 : hi + 1] in self._near:
                    hi += 1
            parts.append(word[lo:hi])
            lo = hi
        return [*parts, word[lo:]] if lo < len(word) else parts

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, begin and end included, as little-endian unsigned 32-bit integers."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            words = self._split(SPACE + text.replace(" ", SPACE)) if text else []
            if len(text) > BLOCK_CHARS:
                words = [p for w in words for p in (self._cut(w) if len(w) > BLOCK_CHARS else [w])]
            held.append(words)
            size += len(text)
            if size > BLOCK_CHARS:
                yield from self._resolve(held)
                held, size = [], 0
        yield from self._resolve(held)

    def _resolve(self, texts: list[list[str]]) -> Iterator[bytes]:
        """The ids of texts given as words; words that are not remembered are merged together, in blocks."""
        known = self._known
        todo = list(set().union(*texts).difference(known))
        lo = chars = 0
        for hi, w in enumerate(todo):
            chars += len(w)
            if chars > BLOCK_CHARS or hi + 1 == len(todo):
                known.update(zip(todo[lo : hi + 1], self._ids_of(todo[lo : hi + 1]), strict=True))
                lo, chars = hi + 1, 0
        for words in texts:
            yield b"".join([self.bos, *map(known.__getitem__, words), self.eos])
        if len(known) > WORDS:
            known.clear()
        else:
            for w in todo:
                if len(w) > WORD_CHARS:
                    del known[w]

    def decode(self, ids: bytes | np.ndarray) -> str:
        """The text of ids; control ids give nothing, the space before the first word goes, bytes that are no UTF-8 become U+FFFD."""
        ids = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else np.asarray(ids)
        raw = b"".join(map(self._bytes.__getitem__, ids.tolist()))
        return raw.decode("utf-8", "graphloom_each_byte").removeprefix(" ")


_MODELS: dict[int, PieceModel] = {}


def _model(shared) -> PieceModel:
    """One model a worker process."""
    key = hash(shared.value)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = PieceModel(shared.value)
    return _MODELS[key]


def _by_batch(docs: DataFrame, model_path: str, fields: list[tuple[str, str]], rows: Callable, read: list) -> DataFrame:
    with open(model_path, "rb") as f:
        proto = f.read(MAX_MODEL_BYTES + 1)
    if len(proto) > MAX_MODEL_BYTES:
        raise ValueError(f"{model_path} is larger than {MAX_MODEL_BYTES} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(proto)
    kept = docs.select(*read)
    schema = ", ".join([f"`{kept.columns[0]}` {kept.dtypes[0][1]}", *(f"{n} {t}" for n, t in fields)])
    types = [{"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[t] for _, t in fields]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        for batch in it:
            key, value = batch.columns
            # rows leave in slices, so that a batch of long texts is not held twice
            for lo in range(0, len(value), SLICE):
                got = list(rows(model, value.slice(lo, SLICE)))
                cols = [pa.array([g[k] for g in got], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([key.slice(lo, SLICE), *cols], names=[batch.schema.names[0], *(n for n, _ in fields)])

    return kept.mapInArrow(run, schema)


def _encoded(model: PieceModel, values: pa.Array) -> Iterator[bytes]:
    return model.encode((v.as_py() or b"").decode("utf-8", "graphloom_each_byte") for v in values)


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the ids of every whole text, begin and end ids included."""
    rows = lambda m, values: ((np.frombuffer(ids, "<i4"),) for ids in _encoded(m, values))
    return _by_batch(docs, model_path, [("ids", "array<int>")], rows, [F.col(id_col), F.col(text_col).cast("binary")])


def decode_ids(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of every row's ids; null gives the empty text."""
    rows = lambda m, values: ((m.decode(np.array(v.as_py() or [], np.int64)),) for v in values)
    return _by_batch(encoded, model_path, [("text", "string")], rows, [F.col(id_col), F.col(ids_col)])


def token_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): of the ids and of what they decode to, without either leaving the worker."""

    def rows(m: PieceModel, values: pa.Array) -> Iterator[tuple[int, str, str]]:
        for ids in _encoded(m, values):
            yield len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(m.decode(ids).encode()).hexdigest()

    return _by_batch(docs, model_path, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], rows, [F.col(id_col), F.col(text_col).cast("binary")])
