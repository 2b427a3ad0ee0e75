"""SentencePiece encoding of merge-type (BPE) models by backtracking, and decoding.

A sequence of pieces is what merging gives if each two neighbours, merged afresh from their characters, give just these two.
So a word is encoded from left to right with the longest piece that an Aho-Corasick automaton finds there and that gets on with
the piece before it; a position where nothing fits is marked in a bit field, for what led there is the only way to it, and one step is taken back.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from kvloom.llm import text as T
from kvloom.llm.tokens import Memory, flat, spans

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
CHUNK_BLOCK = 8 << 20
PAIRS, CORES = 400_000, 120_000
SCHEMA = "doc_id long, n_tokens long, ids string, decoded string"
_workers: dict[str, Pieces] = {}


class Pieces:
    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        kinds = {p.type for p in model.pieces}
        if train.model_type != 2 or not train.byte_fallback or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only merge-type models with byte fallback and plain pieces are handled")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError("only the identity normalisation with a leading space is handled")
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.end = next(i for i, p in enumerate(model.pieces) if p.piece == "</s>")
        self.shown: list[bytes] = [b"" if p.type == CONTROL else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.id):
            raise ValueError("a piece crosses a space or a line end, so texts can't be cut there")
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.text_of = {p: b"%d " % i for p, i in self.id.items()}
        #: Of each piece the length of its longest proper prefix that is a piece, or one character.
        self.shorter = {p: next((k for k in range(len(p) - 1, 1, -1) if p[:k] in self.id), 1) for p in self.id if len(p) > 1}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.cores: dict[str, list[str]] = {}
        self.known, self.backs = Memory(self._payloads, 1_000_000), Memory(self._decoded, 1_000_000)

    # --- encoding ----------------------------------------------------------

    def merged(self, chunk: str) -> list[str]:
        """Pieces by plain merging: the best score first, of equal ones the leftmost."""
        n = len(chunk)
        start, end, after, before = list(range(n)), list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (s := self.score.get(chunk[start[i] : end[j]])) is not None:
                heapq.heappush(heap, (-s, i, end[i], end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, middle, last = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or end[i] != middle or j >= n or end[j] != last:
                continue
            end[i], alive[j], after[i] = last, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [chunk[start[i] : end[i]] for i in range(n) if alive[i]]

    def together(self, a: str, b: str) -> bool:
        """Whether a and b side by side stay as they are when merged afresh; with a empty, whether b is what its characters merge to."""
        score, chunk = self.score.get, a + b
        parts, border = list(chunk), len(a)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            if a and sum(map(len, parts[: at + 1])) == border:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return len(parts) == (2 if a else 1)

    def encode(self, chunk: str) -> list[str]:
        """Pieces of a chunk that is not empty; a character that is no piece stands for itself."""
        if SPACE * 2 in chunk:  # runs of spaces share one score, so the order of merges is not one of pieces
            return self.merged(chunk)
        n, pairs, shorter = len(chunk), self.pairs, self.shorter
        if len(pairs) > PAIRS:
            pairs.clear()
        longest = list(range(1, n + 1))
        for last, size in self.automaton.iter(chunk):  # ends rise, so the longest is put down last
            longest[last - size + 1] = last + 1
        out: list[str] = []
        at, failed, previous, stop = 0, 0, "", longest[0]
        while True:
            piece = chunk[at:stop]
            ok = False
            if not (failed and failed >> stop & 1):
                ok = pairs.get((previous, piece))
                if ok is None:
                    ok = pairs[previous, piece] = self.together(previous, piece)
            if ok:
                out.append(piece)
                if stop == n:
                    return out
                at, previous, stop = stop, piece, longest[stop]
                continue
            while not (size := shorter.get(piece, 0)):  # nothing else starts here: one step back
                failed |= 1 << at
                piece = out.pop()
                at -= len(piece)
                previous = out[-1] if out else ""
            stop = at + size

    def payload(self, pieces: list[str]) -> bytes:
        out = b""
        for p in pieces:
            out += self.text_of.get(p) or b"".join(b"%d " % self.byte[b] for b in p.encode())
        return out

    def _payloads(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks. The marks that end a chunk are set to the pieces of what stands before them, if they get on."""
        out = []
        for chunk in chunks:
            chunk = chunk.replace(" ", SPACE)
            core = chunk.rstrip(".,;:!?&%$*#|")
            if core and core != chunk and len(core) > 3:
                head, tail = self._some(core), self._some(chunk[len(core) :])
                if self.pairs.setdefault((head[-1], tail[0]), None) is None:
                    self.pairs[head[-1], tail[0]] = self.together(head[-1], tail[0])
                out.append(self.payload([*head, *tail] if self.pairs[head[-1], tail[0]] else self.encode(chunk)))
            else:
                out.append(self.payload(self._some(chunk)))
        return out

    def _some(self, chunk: str) -> list[str]:
        found = self.cores.get(chunk)
        if found is None:
            if len(self.cores) > CORES:
                self.cores.clear()
            found = self.cores[chunk] = self.encode(chunk)
        return found

    # --- decoding ----------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """Control ids show nothing, bytes that make no character show U+FFFD, and the leading space goes."""
        raw = b"".join(self.shown[i] for i in ids).decode("utf-8", "replace")
        return raw.removeprefix(" ")

    def _decoded(self, payloads: list[str]) -> list[bytes]:
        return [b"".join(self.shown[int(i)] for i in p.split()) for p in payloads]

    # --- blocks ------------------------------------------------------------

    def block(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """ids and decoded text of each document, and its number of ids, the end id included. Documents that are not empty begin with a space."""
        n = len(offsets) - 1
        space, line = buf == 32, buf == 10
        first = np.zeros(len(buf), bool)
        first[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(first)
        of = np.searchsorted(starts, offsets)
        ending = b"%d" % self.end
        if not len(starts):
            return pa.array([ending.decode()] * n, pa.large_string()), pa.array([""] * n, pa.large_string()), np.ones(n, np.int64)
        chunks = spans(buf, starts)
        payloads = self.known.of(chunks.dictionary)
        sizes = np.asarray(pc.count_substring(payloads, " "))[np.asarray(chunks.indices)]
        total = np.concatenate(([0], np.cumsum(sizes)))
        backs = self.backs.of(payloads.cast(pa.large_string()))
        data, at = flat(pc.take(payloads, chunks.indices))
        raw, back_at = flat(pc.take(backs, chunks.indices))
        data, raw = memoryview(data), memoryview(raw)
        ids = [bytes(data[at[of[i]] : at[of[i + 1]]]) + ending for i in range(n)]
        texts = [bytes(raw[back_at[of[i]] : back_at[of[i + 1]]]).decode("utf-8", "replace").removeprefix(" ") for i in range(n)]
        return pa.array(ids, pa.large_binary()).cast(pa.large_string()), pa.array(texts, pa.large_string()), total[of[1:]] - total[of[:-1]] + 1


def pieces(path: str) -> Pieces:
    if path not in _workers:
        _workers[path] = Pieces(path)
    return _workers[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """One row for each row of documents: doc_id, n_tokens, ids (decimal, joined by one space, the end id last), decoded.

    Whole texts, encoded as the library does; a null or empty text has the end id alone and decodes to the empty text.
    Distinct chunks (a run of spaces and what follows up to the next, or a line end) are encoded once a block and remembered by
    the worker. Other columns are not read, whatever their names; repeated rows give repeated rows, rows with a null doc_id keep it,
    and an empty table gives no rows. A very long text is a block of its own. There is no shuffle.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            texts = pc.replace_substring(pc.fill_null(batch.column(1).cast(pa.large_string()), ""), SPACE, " ")
            lead = pc.if_else(pc.equal(texts, ""), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
            buf, offsets = T.utf8(pc.binary_join_element_wise(lead, texts, pa.scalar("", pa.large_string())))
            at, n = 0, len(offsets) - 1
            while at < n:
                end = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BLOCK, side="right")) - 1))
                ids, decoded, counts = model.block(np.ascontiguousarray(buf[offsets[at] : offsets[end]]), offsets[at : end + 1] - offsets[at])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(counts, pa.int64()), ids.cast(pa.string()), decoded.cast(pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])
                at = end

    return docs.select("doc_id", "text").mapInArrow(rows, SCHEMA)
