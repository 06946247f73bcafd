"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Words of a text are encoded apart: no piece holds a word boundary inside, so no
merge crosses one. New words of a slice are laid out in one flat array of
symbols. A round finds the least pair rank of every word by a segmented minimum
and merges pairs of that rank, leftmost first, in all words at once; then the
array is compacted, words without a pair left are taken out, and the next round
begins. A worker keeps the ids of recent words, since words repeat.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tidewell.llm.common import table, text_batches, text_slices

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NO_PAIR = np.int32(2**31 - 1)
#: Words that a worker remembers, and the longest of them; the table is emptied when it is full.
REMEMBERED, LONGEST_KEPT = 150_000, 48
#: A longer text is cut into words in pieces, so that the list of its words stays small.
LONG_TEXT, PIECE_WORDS = 1 << 20, 1 << 16


class PieceBpe:
    """A model of kind BPE with byte fallback, identity normalisation and a space put before the text.

    Other models raise ValueError: their rules are not implemented.
    """

    def __init__(self, path: str) -> None:
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm = model.normalizer_spec
        kinds = [p.type for p in model.pieces]
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or model.trainer_spec.treat_whitespace_as_suffix or {USER_DEFINED, UNUSED} & {*kinds}:
            raise ValueError("this kind of SentencePiece model isn't supported")
        pieces = [p.piece for p in model.pieces]
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == NORMAL}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("a piece holds a word boundary")
        self.byte_ids = np.zeros(256, np.int32)
        for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
            if k == BYTE:
                self.byte_ids[int(p[1:-1], 16)] = i
        # Single characters that only occur inside pieces are symbols as well, without an id.
        symbols = dict(self.ids)
        for p in self.ids:
            for ch in p:
                symbols.setdefault(ch, len(pieces) + len(symbols))
        self.n_pieces, self.symbols = len(pieces), symbols
        # Pieces of one score share a rank; the leftmost of them merges first.
        scores = sorted({model.pieces[i].score for i in self.ids.values()}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        keys, ranks, merged = [], [], []
        for p, i in self.ids.items():
            for cut in range(1, len(p)):
                a, b = symbols.get(p[:cut]), symbols.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ranks.append(rank_of[model.pieces[i].score])
                    merged.append(i)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.ranks, self.merged = (np.array(x, t)[order] for x, t in ((keys, np.int64), (ranks, np.int32), (merged, np.int32)))
        # Runs of spaces: their pieces rank last and alike, so a run is cut from the left; see _spaces().
        runs = {len(p): i for p, i in self.ids.items() if not p.strip(SPACE)}
        self.runs = runs
        last = {rank_of[model.pieces[i].score] for n, i in runs.items() if n > 1}
        others = {rank_of[model.pieces[i].score] for p, i in self.ids.items() if p.strip(SPACE) and len(p) > 1}
        self.lonely_runs = len(last) == 1 and max(others, default=-1) < min(last) and 1 in runs
        self.run_rank = min(last) if self.lonely_runs else -1
        code = [ord(p) for p in symbols if len(p) == 1]
        self.chars = np.array(sorted(code), np.int64)
        self.char_symbols = np.array([symbols[chr(c)] for c in self.chars], np.int32)
        raw = [bytes([int(p[1:-1], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() if k == NORMAL else b"" for p, k in zip(pieces, kinds, strict=True)]
        raw[model.trainer_spec.unk_id] = model.trainer_spec.unk_surface.encode()
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.piece_lengths = np.array([len(x) for x in raw], np.int64)
        self.piece_starts = np.cumsum(self.piece_lengths) - self.piece_lengths
        self.decimals = [str(i).encode() for i in range(len(pieces))]
        self.known: dict[str, bytes] = {}
        self.passing: list[str] = []  # long words, known for one slice

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text with the spaces before them, line ends apart, in lists of bounded length."""
        text = SPACE + text.replace(" ", SPACE)
        if len(text) <= LONG_TEXT + 1:
            yield WORDS.findall(text)
            return
        found = (m.group() for m in WORDS.finditer(text))
        while part := list(itertools.islice(found, PIECE_WORDS)):
            yield part

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece that two symbols make; NO_PAIR where there is none."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = (self.keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NO_PAIR), np.where(hit, self.merged[at], -1)

    def _spaces(self, n: int) -> list[int]:
        """Pieces of n single spaces in a row: the leftmost pair first, as all rank alike."""
        most, parts = max(self.runs), []
        parts = [most] * (n // most) + [1] * (n % most) if all(self._grows(k) for k in (most,)) else [1] * n
        i = 0
        while i + 1 < len(parts):
            if parts[i] + parts[i + 1] in self.runs:
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                i = max(0, i - 1)
            else:
                i += 1
        return [self.runs[k] for k in parts]

    def _grows(self, most: int) -> bool:
        """Whether the longest run comes about from single spaces, leftmost pair first."""
        parts = [1] * most
        i = 0
        while i + 1 < len(parts):
            if parts[i] + parts[i + 1] in self.runs:
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                i = max(0, i - 1)
            else:
                i += 1
        return parts == [most]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of every word, as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = np.array([len(w) for w in words], np.int64)
        at = np.minimum(np.searchsorted(self.chars, code), len(self.chars) - 1)
        # A character that no piece holds is a symbol of its own kind, -1 - code point: it never merges.
        sym = np.where(self.chars[at] == code, self.char_symbols[at], -1 - code).astype(np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        last = np.zeros(len(sym), bool)
        last[np.cumsum(lengths)[lengths > 0] - 1] = True
        rank = np.full(len(sym), NO_PAIR, np.int32)
        piece = np.full(len(sym), -1, np.int32)

        def pairs(where: np.ndarray) -> None:
            where = where[~last[where]]
            rank[where], piece[where] = self._lookup(sym[where], sym[where + 1])

        pairs(np.arange(len(sym)))
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(sym)])
            least = np.minimum.reduceat(rank, starts)
            done = (least == NO_PAIR) | (self.lonely_runs & (least == self.run_rank))
            if done.any():
                self._take_out(out, sym, word, starts, sizes, done)
                left = np.repeat(~done, sizes)
                sym, word, last, rank, piece = sym[left], word[left], last[left], rank[left], piece[left]
                continue
            of_word = np.repeat(np.arange(len(starts)), sizes)
            spots = np.flatnonzero(rank == least[of_word])
            spots = _leftmost(spots)
            # What follows a merge must not rank before it; if it does, or ties, only the word's first merge counts.
            new = piece[spots].astype(np.int64)
            before, after = spots - 1, spots + 2
            has_left = np.zeros(len(spots), bool)
            has_left[:] = (before >= 0) & (word[np.maximum(before, 0)] == word[spots])
            left_sym = np.where(has_left, sym[np.maximum(before, 0)], -1)
            joined = has_left & np.r_[False, spots[1:] - spots[:-1] == 2]
            left_sym = np.where(joined, np.r_[-1, new[:-1]], left_sym)
            has_right = (after < len(sym)) & (word[np.minimum(after, len(sym) - 1)] == word[spots])
            right_sym = np.where(has_right, sym[np.minimum(after, len(sym) - 1)], -1)
            merged_rank = rank[spots]
            early = np.zeros(len(spots), bool)
            for a, b in ((left_sym, new), (new, right_sym)):
                early |= self._lookup(a, b)[0] <= merged_rank
            # Sequentially, the right one of two merges side by side still stands apart when the left one is made.
            beside = np.flatnonzero(joined)
            early[beside - 1] |= self._lookup(new[beside - 1], sym[spots[beside]])[0] <= merged_rank[beside]
            first = np.r_[True, word[spots[1:]] != word[spots[:-1]]]
            if early.any():
                hasty = np.zeros(len(starts), bool)
                hasty[of_word[spots[early]]] = True
                spots = spots[first | ~hasty[of_word[spots]]]
                new = piece[spots].astype(np.int64)
            sym[spots] = new
            last[spots] = last[spots + 1]
            stay = np.ones(len(sym), bool)
            stay[spots + 1] = False
            moved = np.cumsum(stay) - 1
            sym, word, last, rank, piece = sym[stay], word[stay], last[stay], rank[stay], piece[stay]
            spots = moved[spots]
            rank[spots], piece[spots] = NO_PAIR, -1
            before = spots[spots > 0] - 1
            touched = np.zeros(len(sym), bool)
            touched[spots] = touched[before] = True
            pairs(np.flatnonzero(touched))
        return out

    def _take_out(self, out: list[bytes], sym: np.ndarray, word: np.ndarray, starts: np.ndarray, sizes: np.ndarray, done: np.ndarray) -> None:
        plain = (sym >= 0) & (sym < self.n_pieces)
        run = self.runs.get(1, -2)
        odd = ~plain
        if self.lonely_runs:
            odd[:-1] |= (sym[:-1] == run) & (sym[1:] == run) & (word[:-1] == word[1:])
        odd_words = np.logical_or.reduceat(odd, starts)
        raw = sym.astype("<i4").tobytes()
        for k in np.flatnonzero(done):
            a, n = int(starts[k]), int(sizes[k])
            if not odd_words[k]:
                out[word[a]] = raw[4 * a : 4 * (a + n)]
                continue
            ids: list[int] = []
            for s, group in itertools.groupby(sym[a : a + n].tolist()):
                count = sum(1 for _ in group)
                if s == run and self.lonely_runs:
                    ids += self._spaces(count)
                elif 0 <= s < self.n_pieces:
                    ids += [s] * count
                else:
                    ids += self.byte_ids[list(self._char(s).encode())].tolist() * count
            out[word[a]] = np.array(ids, "<i4").tobytes()

    def _char(self, symbol: int) -> str:
        return chr(-1 - symbol) if symbol < 0 else next(c for c, s in self.symbols.items() if s == symbol)

    def _learn(self, words: Iterable[str]) -> None:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        self.passing += [w for w in fresh if len(w) > LONGEST_KEPT]
        for at in range(0, len(fresh), PIECE_WORDS):
            new = fresh[at : at + PIECE_WORDS]
            known.update(zip(new, self.encode_words(new), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text; new words of all the shorter texts go through the rounds together."""
        known, found = self.known, []
        split = [[] if not t else next(self.words(t)) if len(t) < LONG_TEXT else None for t in texts]
        self._learn(itertools.chain.from_iterable(x for x in split if x))
        for text, words in zip(texts, split, strict=True):
            if words is not None:
                raw = b"".join(map(known.__getitem__, words))
            else:
                parts = []
                for some in self.words(text):
                    self._learn(some)
                    parts.append(b"".join(map(known.__getitem__, some)))
                raw = b"".join(parts)
                self._learn(itertools.chain.from_iterable(x for x in split if x))
            found.append(np.frombuffer(raw, "<i4"))
        for w in self.passing:
            known.pop(w, None)
        self.passing.clear()
        return found

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: the bytes of all pieces, without the space put before the text."""
        if not len(ids):
            return ""
        lengths = self.piece_lengths[ids]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(self.piece_starts[ids] - (ends - lengths), lengths)
        text = self.piece_bytes[at].tobytes()
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


WORDS = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


def _leftmost(spots: np.ndarray) -> np.ndarray:
    """Of places in a row, which would overlap, every second one: first, third, and so on."""
    if not len(spots):
        return spots
    fresh = np.r_[True, spots[1:] - spots[:-1] > 1]
    begin = spots[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    return spots[(spots - begin) % 2 == 0]


_models: dict[str, PieceBpe] = {}


def model(path: str) -> PieceBpe:
    if path not in _models:
        _models[path] = PieceBpe(path)
    return _models[path]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids array of int): the ids of every whole text, without begin or end ids.

    Null and empty texts have no ids. Repeated rows give a row each, a null id
    stays null, an empty table gives an empty result. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(model_path)
        for part, texts in text_slices(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bpe.encode(texts), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return text_batches(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """Rows (doc_id, text) of rows (doc_id, ids); null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [None if x is None else bpe.decode(np.array(x, np.int64)) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, digests of the ids and of the decoded text, and the ids if asked for.

    Null and empty texts have no ids. Repeated rows give a row each, a null id stays
    null, an empty table gives an empty result. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(model_path)
        for part, texts in text_slices(batches, 1):
            counts, of_ids, of_text, all_ids = [], [], [], []
            for ids in bpe.encode(texts):
                counts.append(len(ids))
                digest = hashlib.sha256()
                for at in range(0, len(ids), 1 << 18):
                    digest.update(b"," * (at > 0) + b",".join(map(bpe.decimals.__getitem__, ids[at : at + (1 << 18)].tolist())))
                of_ids.append(digest.hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                all_ids.append(ids)
            columns = {"doc_id": part.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(of_ids), "decoded_sha256": pa.array(of_text)}
            if with_ids:
                columns["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return text_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(run, schema)


def op5_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode whole documents with piece_bpe_32k.model."""
    import public_tokenizers

    return round_trip_digests(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
