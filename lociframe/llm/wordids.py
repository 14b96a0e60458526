"""Token ids of whole texts by the tokenizers library, word by word with a bounded cache in each Python worker."""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import held_by_worker, text_blocks

#: Words of one generation of a worker's cache; at most two generations are held.
CACHE_WORDS = 300_000
#: Bytes of text that are encoded at a time.
TEXT_BYTES = 4 << 20
_ENCODERS: dict[str, "WordIds"] = held_by_worker({})


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> "WordIds":
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def _list(words: pa.LargeBinaryArray) -> list[bytes]:
    edges, raw = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1].tolist(), words.buffers()[2]
    raw = raw.to_pybytes() if raw is not None else b""
    return [raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


class WordIds:
    """Ids of a text for a tokenizer that lower-cases and never joins across white space.

    Such a tokenizer's ids for a text are those of its white-space separated words, end to end, so each
    word is handed to the library once. Words of printable letters up to U+024F are cut by the
    tokenizer's own pattern and go to the library's model piece by piece; all others, and texts for
    tokenizers of another kind, go through the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.size = self.lib.get_vocab_size()
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cut = self._pattern(spec)
        self.by_word = self.cut is not None
        # byte-level models write a byte without a printable Latin-1 letter as the next letter from U+0100 on
        bare = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
        self.letters = {b: 256 + i for i, b in enumerate(bare)}

    def _pattern(self, spec: dict):
        """The compiled pattern that cuts words, or None where the tokenizer does not work word by word."""
        import regex

        steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        blanks = '"\\\\s+"' in json.dumps(spec.get("normalizer"))
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        model = spec["model"]
        whole = (
            steps == ["NFC", "Replace", "Lowercase"] and blanks and len(cuts) == 2
            and (cuts[0].get("type"), cuts[0].get("behavior"), cuts[0].get("invert")) == ("Split", "Removed", True)
            and (cuts[1].get("type"), cuts[1].get("add_prefix_space"), cuts[1].get("use_regex")) == ("ByteLevel", False, False)
            and model["type"] == "BPE" and not model.get("continuing_subword_prefix") and not model.get("dropout")
        )
        if not whole:
            return None
        cut = regex.compile(cuts[0]["pattern"]["Regex"])
        probe = "ab cd!? it's 12 x,y ... 'll"
        pieces = cut.findall(probe)
        same = pieces == [p for p, _ in self.lib.pre_tokenizer.pre_tokenize_str(probe)]
        return cut if same and not any(c.isspace() for p in pieces for c in p) else None

    def _pack(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of what the pattern has cut; a piece is also a word."""
        key = piece.encode()
        found = self.known.get(key)
        if found is None:
            letters = piece if piece.isascii() else key.decode("latin-1").translate(self.letters)
            found = self.known[key] = self._pack([t.id for t in self.lib.model.tokenize(letters)])
        return found

    def _learn(self, words: set[bytes]) -> None:
        if len(self.known) > CACHE_WORDS:
            self.old, self.known = self.known, {}
        odd = []
        for w in words:
            found = self.old.get(w)
            if found is not None:
                self.known[w] = found
                continue
            s = w.decode("utf-8", "replace")
            if not s.isprintable() or not (s.isascii() or (max(s) < "ɐ" and "İ" not in s)) or "<|" in s:
                odd.append((w, s))
                continue
            s = s.lower()
            if s.isascii() and s.isalpha():
                self.known[w] = self._pack([t.id for t in self.lib.model.tokenize(s)])
            else:
                self.known[w] = b"".join(map(self._piece, self.cut.findall(s)))
        for i in range(0, len(odd), 1024):
            some = odd[i : i + 1024]
            for (word, _), e in zip(some, self.lib.encode_batch_fast([s for _, s in some], add_special_tokens=False), strict=True):
                self.known[word] = self._pack(e.ids)

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, from the cache or the library."""
        found = list(map(self.known.get, words))
        missing = {w for w, x in zip(words, found, strict=True) if x is None}
        if missing:
            self._learn(missing)
            found = [self.old.get(w, b"") if (x := self.known.get(w)) is None else x for w in words]
        return found

    def __call__(self, texts: pa.Array, end_id: int) -> pa.Array:
        """For each text, null as empty, its ids and the end id as little-endian bytes of ``dtype``."""
        texts = texts.fill_null("") if texts.null_count else texts
        end = self._pack([end_id])
        if not self.by_word:
            ids = self.lib.encode_batch([t.decode("utf-8", "replace") for t in texts.cast(pa.large_binary()).to_pylist()], add_special_tokens=False)
            return pa.array([self._pack(e.ids) + end for e in ids], pa.binary())
        low = pc.ascii_lower(texts)
        special = pc.match_substring(texts, "<|")  # special tokens count as they are written
        words = pc.ascii_split_whitespace(pc.if_else(special, texts, low) if pc.any(special).as_py() else low)
        cuts = words.offsets.to_numpy().astype(np.int64)
        flat = words.flatten().cast(pa.large_binary()).dictionary_encode()
        table = pa.array([*self._ids_of(_list(flat.dictionary)), end], pa.large_binary())
        places = np.insert(flat.indices.to_numpy(), cuts[1:] - cuts[0], len(flat.dictionary))  # the end id after each text
        ids = table.take(pa.array(places))
        edges = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(edges[cuts - cuts[0] + np.arange(len(cuts))].tobytes()), ids.buffers()[2]])


def id_rows(path: str, end_id: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (doc_id, text) to (doc_id, n_tokens, ids), the end id appended."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        width = np.dtype(enc.dtype).itemsize
        for rows, _, _ in text_blocks(batches, limit=TEXT_BYTES):
            ids = enc(rows.column(1), end_id).cast(pa.binary())
            n = pc.cast(pc.divide(pc.binary_length(ids), width), pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0), n, ids], names=["doc_id", "n_tokens", "ids"])
        pa.default_memory_pool().release_unused()  # workers outlive tasks

    return run
