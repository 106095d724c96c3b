"""Encoding of whole texts with the tokenizers library, memoised by pre-token.

A byte-level or word BPE tokenizer splits a text by a fixed pattern and merges within each piece alone, so the ids of a
text are the ids of its pieces in a row. Text is cut where that pattern always cuts; such chunks repeat far more
often than they are new, and each is encoded by the library once a worker and then looked up. The patterns here, which
count a chunk's pieces, equal the tokenizers' own on characters up to U+00FF; a text with any other character, with a
control character that Python and the tokenizer class differently, with the string of an added token, or with a space
before white space or at its end is handed to the library whole, so that its ids are the library's.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

# Letters and numbers of Latin-1, as in the tokenizers' \p{L} and \p{N}.
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBER = "0-9\xb2\xb3\xb9\xbc\xbd\xbe"
PIECES = {
    "byte_bpe_50k.json": rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+",
    "word_bpe_49k.json": rf"'(?:s|t|re|ve|m|ll|d)|[{LETTER}]+|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+",
}
LOWER = {"word_bpe_49k.json"}
#: A space before white space or the end; a line end before white space; a stop or comma that follows no letter or number.
_RAGGED = re.compile(r" (?:\s|\Z)").search
_BREAKS = re.compile(r"\n\s").search
_POINTS = re.compile(rf"[.,](?<![{LETTER}{NUMBER}][.,])").search
#: Marks a chunk that no space comes before.
BARE = "\x01"
_CONTROL = b"\x01\x1c\x1d\x1e\x1f"
#: Chunks kept a worker; past it, new ones are encoded each time they come.
MEMO = 400_000
#: Characters encoded at once, or one text.
RUN = 2_000_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _plain(text: str) -> bool:
    """Whether the patterns above split ``text`` as the tokenizer does, added tokens aside."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return len(raw.translate(None, _CONTROL)) == len(raw)


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers.

    They are the library's with ``add_special_tokens=False``. With ``apart``, the strings of special tokens in a text are
    ordinary text, so that no text holds a special token's id.
    """

    def __init__(self, path: str, memo: int | None = None, apart: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        name = os.path.basename(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = apart
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        lead = re.match("[^A-Za-z]*", os.path.commonprefix(added))[0]
        # their common first characters, or, where they have none, themselves
        self.added = (lambda text: False) if not added else (lambda text: lead in text) if lead else re.compile("|".join(map(re.escape, added)), re.I).search
        self.findall = re.compile(PIECES[name]).findall if name in PIECES else None
        self.lower = name in LOWER
        self.memo: dict[str, bytes] = {"": b"", BARE: b""}
        self.size = memo

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _new(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks not met before, encoded in runs and cut where the library says a word ends.

        A bare chunk follows a line end there, whose ids are left out; one with white space inside is encoded alone.
        """
        out: dict[str, bytes] = {}
        letters = [c for c in chunks if c.isalpha()]  # a word each
        for i in range(0, len(letters), 512):
            part = letters[i : i + 512]
            got = self.tokenizer.encode(" " + " ".join(part), add_special_tokens=False)
            ends = np.flatnonzero(np.diff(got.word_ids, append=-1)) * 4 + 4
            if len(ends) == len(part):
                ids, ends = np.array(got.ids, dtype="<u4").tobytes(), ends.tolist()
                out.update(zip(part, [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        chunks = [c for c in chunks if c not in out]
        bare = [c[0] == BARE for c in chunks]
        text = [c[b:] for c, b in zip(chunks, bare, strict=True)]
        lead = ["\n" if b else " " for b in bare]
        joint = [k for k, t in enumerate(text) if not t[-1:].isspace() and not t[:1].isspace()]
        for i in range(0, len(joint), 512):
            part = joint[i : i + 512]
            skip = np.array([bare[k] and not self.lower for k in part], dtype=np.int64)
            words = np.array([1 if text[k].isalpha() else len(self.findall(lead[k] + text[k])) - (bare[k] and not self.lower) for k in part])
            got = self.tokenizer.encode("".join([lead[k] + text[k] for k in part]), add_special_tokens=False)
            owner, last = np.array(got.word_ids, dtype=np.int64), np.cumsum(words + skip) - 1
            if not len(owner) or owner[-1] != last[-1] or (words < 1).any():
                continue
            ids = np.array(got.ids, dtype="<u4").tobytes()
            starts, ends = np.searchsorted(owner, last - words + 1) * 4, np.searchsorted(owner, last, side="right") * 4
            for k, start, end in zip(part, starts.tolist(), ends.tolist(), strict=True):
                out[chunks[k]] = ids[start:end]
        rest = [k for k, c in enumerate(chunks) if c not in out]
        out.update(zip([chunks[k] for k in rest], self._whole([text[k] if bare[k] or self.lower else " " + text[k] for k in rest]), strict=True))
        return out

    def _spaced(self, text: str) -> str | None:
        """The text with spaces where the tokenizer's pattern always cuts; None if it must be encoded whole.

        A space before a character that isn't white space begins a new piece, as does a stop, comma or line end that stands
        alone, and what follows them.
        """
        if not _plain(text) or self.added(text):
            return None
        if self.lower:
            text = text.lower().replace("\n", " ")
            return text if _POINTS(text) else text.replace(",", " ,").replace(".", " .")
        if _RAGGED(text):
            return None
        text = BARE + text
        if not _POINTS(text):
            text = text.replace(",", f" {BARE},").replace(".", f" {BARE}.")
        if not _BREAKS(text):
            text = text.replace("\n", f" {BARE}\n {BARE}")
        return text

    def encode(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        if not self.findall:
            return self._whole(texts)
        out, held, size = [], [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= RUN:
                out += self._run(held)
                held, size = [], 0
        return out + self._run(held) if held else out

    def _run(self, texts: list[str]) -> list[bytes]:
        """Distinct chunks of the texts are looked up once; their ids are gathered by numpy."""
        import pyarrow as pa
        import pyarrow.compute as pc

        spaced = [self._spaced(t) for t in texts]
        whole = iter(self._whole([t for t, c in zip(texts, spaced, strict=True) if c is None]))
        lists = pc.split_pattern(pa.array([c for c in spaced if c is not None], pa.string()), " ")
        offsets, coded = lists.offsets.to_numpy(), lists.values.dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        ids = list(map(self.memo.get, chunks))
        holes = [k for k, v in enumerate(ids) if v is None]
        if holes:
            own = self._new([chunks[k] for k in holes])
            for k in holes:
                ids[k] = own[chunks[k]]
            if len(self.memo) + len(own) <= (self.size or MEMO):
                self.memo.update(own)
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(n) - n
        index = coded.indices.to_numpy()
        size = n[index]
        ends = np.cumsum(size)
        data = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[index] - ends + size, size)].tobytes()
        bounds = iter((np.concatenate([[0], ends])[offsets] * 4).tolist())
        start, out = next(bounds), []
        for c in spaced:
            if c is None:
                out.append(next(whole))
            else:
                end = next(bounds)
                out.append(data[start:end])
                start = end
        return out


@lru_cache(maxsize=4)
def encoder(path: str, memo: int | None = None, apart: bool = False) -> Encoder:
    """A worker's encoder; ``memo``: how many chunks it keeps, MEMO if not given."""
    return Encoder(path, memo, apart)
