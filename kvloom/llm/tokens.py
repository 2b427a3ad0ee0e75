"""Token ids of whole texts, each distinct word encoded once.

The tokenizer drops white space and never joins across it, so the ids of a text are those of its words in turn.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kvloom.llm import text as T

#: Bytes of text whose words meet in one dictionary, and words that a worker remembers (some 40 bytes each).
DICTIONARY_BLOCK = 8 << 20
REMEMBERED = 700_000
#: Latin letters, then plain marks. Lower-casing one of these letters gives one letter, and none of them composes with what stands beside it.
PLAIN = "^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[.,;:!?|]*)$"
_workers: dict = {}


class Memory:
    """Payloads of words, as Arrow arrays: what was asked before is not made again."""

    def __init__(self, make: Callable[[list[str]], list[bytes]], limit: int = REMEMBERED) -> None:
        self.make, self.limit = make, limit
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.payloads = pa.array([], pa.large_binary())

    def of(self, words: pa.Array) -> pa.Array:
        """Payload of each word."""
        if len(self.words) > self.limit:
            self.clear()
        found = words.dictionary_encode()
        distinct = found.dictionary.cast(pa.large_string())
        at = pc.index_in(distinct, value_set=self.words)
        if at.null_count:
            new = distinct.filter(pc.is_null(at))
            made = pa.array(self.make(new.to_pylist()), pa.large_binary())
            places = np.where(at.is_null(), 0, at.fill_null(0)).astype(np.int64)
            places[np.asarray(at.is_null())] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, new])
            self.payloads = pa.concat_arrays([self.payloads, made])
            at = pa.array(places)
        return pc.take(pc.take(self.payloads, at), found.indices)


def spans(buf: np.ndarray, starts: np.ndarray) -> pa.DictionaryArray:
    """The strings from each start to the next, the last to the end of the buffer, as a dictionary."""
    edges = np.append(starts, len(buf)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(buf))).dictionary_encode()


def flat(payloads: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all payloads in turn, and their offsets (n + 1)."""
    offsets = np.frombuffer(payloads.buffers()[1], np.int64)[payloads.offset : payloads.offset + len(payloads) + 1]
    data = payloads.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


#: Stands for the word end in the fast encoder; plain words don't hold it.
END = b"\0"


def word_end_encoder(path: str):
    """The tokenizer's merges for plain words in another library's faster engine, with the set of ids that end a word; None if they don't carry over.

    A token "ab</w>" becomes the bytes of "ab" and END. The lowest id merges first, which is the order of the merge list
    where the ids past the 512 bytes and word-ending bytes number that list, as is checked here.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if model.get("end_of_word_suffix") != "</w>" or any(vocab[a + b] != 512 + i for i, (a, b) in enumerate(merges)):
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks: dict[bytes, int] = {}
    ends = np.zeros(1 << 16, bool)
    for token, number in vocab.items():
        if number >= 512 + len(merges):
            continue
        last = token.endswith("</w>") and token != "</w>"
        key = bytes(byte_of[c] for c in (token[:-4] if last else token)) + (END if last else b"")
        ranks[key] = number
        ends[number] = last
    ranks[END] = 60_000
    return tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={}), ends


class WordIds:
    """Words to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), word_end_encoder(path)
        self.cores, self.odd, self.tails = Memory(self._plain), Memory(self._encode, 200_000), Memory(self._encode, 10_000)

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Of words that are runs of PLAIN's letters in lower case; an empty one has no ids."""
        if self.fast is None:
            return self._encode(texts)
        encoder, ends = self.fast
        out: list[bytes] = []
        for at in range(0, len(texts), 50_000):
            part = texts[at : at + 50_000]
            ids = np.array(encoder.encode_ordinary(" ".join(w + "\0" for w in part if w)), np.uint32)
            data, edges = ids.tobytes(), [0, *((np.flatnonzero(ends[ids]) + 1) * 4).tolist()]
            cuts = iter(zip(edges[:-1], edges[1:], strict=True))
            out += [data[slice(*next(cuts))] if w else b"" for w in part]
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 4096):
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]
        return out

    def forget(self) -> None:
        """Gives back what is remembered of words: a worker outlives its task, and the next may need the memory."""
        for memory in (self.cores, self.odd, self.tails):
            memory.clear()
        T.give_back()

    def words(self, words: pa.Array) -> pa.Array:
        words = pc.ascii_trim_whitespace(words)
        parts = pc.extract_regex(words, PLAIN)
        core, tail = parts.field(0), parts.field(1)
        odd = pc.is_null(parts)
        nothing = pa.scalar("", words.type)
        rest = pc.if_else(odd, words, nothing)
        core, tail = pc.utf8_lower(pc.if_else(odd, nothing, core)), pc.if_else(odd, nothing, tail)
        return pc.binary_join_element_wise(self.cores.of(core), self.tails.of(tail), self.odd.of(rest), pa.scalar(b"", pa.large_binary()))

    def block(self, b: T.Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block, and where each document's start (n + 1)."""
        if not len(b.starts):
            return np.zeros(0, np.uint32), np.zeros(b.n + 1, np.int64)
        buf = b.buf.copy()
        buf[T.IS_SPACE[buf]] = 32
        words = spans(buf, b.starts)
        data, offsets = flat(pc.take(self.words(words.dictionary), words.indices))
        return data[: offsets[-1]].view("<u4"), offsets[b.words] // 4


def word_ids(path: str) -> WordIds:
    """One for each worker process and file. The tokenizer is kept between tasks; words are remembered until forget()."""
    if path not in _workers:
        _workers[path] = WordIds(path)
    return _workers[path]
