"""Token ids of whole texts, byte for byte what the tokenizers library gives for the text as one string.

Both public tokenizers cut a text at white space before they merge anything, so a
text is the concatenation of its space-separated pieces. A worker encodes each
piece once and looks repeats up; prose repeats most of its words.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_WORDS, CACHE_PIECES = 400_000, 100_000  # entries of a worker's tables, some 100 MB, from which they are emptied
SLICE, SLICE_CHARS = 256, 4_000_000  # texts and characters that are encoded together

# White space other than the plain space and line feed, and what only Python counts as such.
_RARE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_RARE_BYTES = b"\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
# A word of Latin letters and the marks after it: two cuts of the tokenizer, known without asking it.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
_SIMPLE = re.compile(f"({_LETTERS})([.,;:!?]*)")
_PLAIN = f"^(?P<word>{_LETTERS})(?P<marks>[.,;:!?]*)$"


def encoder(path: str, leading_space: bool) -> "Encoder":
    """The worker's encoder of a tokenizer file, loaded once per process.

    This package's functions travel to the workers by value, with fresh globals for
    every task. What is to last from task to task is kept with the imported library.
    """
    import tokenizers

    loaded = vars(tokenizers).setdefault("_encoders_of_tasks", {})
    if (path, leading_space) not in loaded:
        loaded[path, leading_space] = Encoder(path, leading_space)
    return loaded[path, leading_space]


def cuts_at_each_space(text: str) -> bool:
    """Whether every space stands alone between two other characters, and there is no white space but it and line feeds."""
    if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " ":
        return False
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return _RARE.search(text) is None
    return len(raw.translate(None, _RARE_BYTES)) == len(raw)


def _gather(values: np.ndarray, begin: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` that begin and are wide as said, end to end."""
    upto = np.cumsum(width)
    return values[np.repeat(begin - (upto - width), width) + np.arange(upto[-1] if len(upto) else 0)]


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as one printable letter: bytes that print keep their own, the
    others are numbered from 256 on. Here for the space and the Latin letters beyond ASCII."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letter, others = {b: chr(b) for b in keep}, [b for b in range(256) if b not in keep]
    letter |= {b: chr(256 + i) for i, b in enumerate(others)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in (32, *range(0xC0, 0x100))}


class Encoder:
    """``leading_space``: the tokenizer keeps the space before a word as part of it (byte-level BPE);
    otherwise it lower-cases and drops white space."""

    def __init__(self, path: str, leading_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.leading_space = leading_space
        self.separator = "<|endoftext|>"
        self.separator_id = self.tokenizer.token_to_id(self.separator)
        self.inner: dict[str, bytes] = {}  # pieces after the first, encoded with their space
        self.first: dict[str, bytes] = {} if leading_space else self.inner
        self.spaced: dict[str, bytes] = {}  # words by themselves, with and without a space before them
        self.bare: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.line_feed = self.whole("\n")  # between two words a cut of its own

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _cut(self, word: str) -> bytes:
        """Ids of one cut, in the model's own alphabet."""
        ids = [t.id for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str, spaced: bool) -> bytes:
        """Ids of a word of Latin letters, lower-cased if the vocabulary is; words are kept, since each comes with several marks."""
        known = self.spaced if spaced else self.bare
        ids = known.get(word)
        if ids is None:
            own = word if word.isascii() else word.translate(self.letters)
            ids = known[word] = self._cut(self.letters[32] + own if spaced else own)
        return ids

    def _mark(self, marks: str) -> bytes:
        if marks not in self.marks:
            self.marks[marks] = self._cut(marks) if marks else b""
        return self.marks[marks]

    def _plain(self, part: str, spaced: bool) -> bytes | None:
        """Ids of a plain word with its marks; None for anything else."""
        if (m := _SIMPLE.fullmatch(part)) is None:
            return None
        return self._word(m[1] if self.leading_space else m[1].lower(), spaced) + self._mark(m[2])

    def _learn(self, cache: dict[str, bytes], missing: list[str], prefix: str) -> None:
        """Encode pieces: plain words by themselves, the others many in one call, kept apart by the special token."""
        spaced = bool(prefix)
        for p in missing:
            parts = [self._plain(part, spaced and not i) for i, part in enumerate(p.split("\n"))]
            if None not in parts:
                cache[p] = self.line_feed.join(parts)
        rest = [p for p in missing if p not in cache]
        plain = [p for p in rest if "<|" not in p]
        for i in range(0, len(plain), 2000):
            some = plain[i:i + 2000]
            joined = self.separator.join([prefix + p for p in some])
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.separator_id)
            raw, start = ids.tobytes(), 0
            for p, end in zip(some, [*cuts.tolist(), len(ids)], strict=True):
                cache[p] = raw[4 * start:4 * end]
                start = end + 1
        for p in rest:
            if "<|" in p:
                cache[p] = self.whole(prefix + p)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):  # slices bounded by rows and, but for one long text alone, by characters
            to, size = at, 0
            while to < len(texts) and to - at < SLICE and (to == at or size < SLICE_CHARS):
                size += len(texts[to] or "")
                to += 1
            out += self._encode(texts[at:to])
            at = to
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        """A slice at a time: its texts are cut and numbered by their distinct pieces, and those by their distinct words;
        each word is looked up or encoded once, and the ids are gathered by these numbers."""
        if sum(map(len, (self.spaced, self.bare))) > CACHE_WORDS:
            self.spaced.clear()
            self.bare.clear()
        if sum(map(len, {id(t): t for t in (self.inner, self.first)}.values())) > CACHE_PIECES:
            self.inner.clear()
            self.first.clear()
        even = [i for i, t in enumerate(texts) if t and cuts_at_each_space(t)]
        out = [b"" if not t else None for t in texts]
        if even:
            strings = pa.array([texts[i] for i in even], pa.large_string())
            if not self.leading_space:
                strings = pc.replace_substring(strings, "\n", " ")  # white space is dropped, whichever it is
            lists = pc.split_pattern(strings, " ")
            numbered = lists.flatten().dictionary_encode()
            number, bounds = numbered.indices.to_numpy(), lists.offsets.to_numpy()
            used, heads = np.ones(len(numbered.dictionary), bool), [b""] * len(even)
            if self.leading_space:  # a text's first piece has no space before it
                some = numbered.dictionary.take(pa.array(number[bounds[:-1]])).to_numpy(zero_copy_only=False).tolist()
                self._known(self.first, set(some), "")
                heads = [self.first[p] for p in some]
                rest = np.ones(len(number), bool)
                rest[bounds[:-1]] = False
                used[:] = False
                used[number[rest]] = True
            flat, width = self._pieces(numbered.dictionary, used)
            n = width[number]
            if self.leading_space:
                n[bounds[:-1]] = 0
            gathered = _gather(flat, (np.cumsum(width) - width)[number], n)
            ends = np.r_[0, np.cumsum(n)][bounds].tolist()
            for k, i in enumerate(even):
                out[i] = heads[k] + gathered[ends[k]:ends[k + 1]].tobytes()
        for i, t in enumerate(texts):
            if out[i] is None:
                out[i] = self._uneven(t)
        return out

    def _pieces(self, distinct: pa.Array, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces end to end, how many each has); pieces that aren't ``used`` have none."""
        found = pc.extract_regex(distinct, _PLAIN)
        plain = found.is_valid().to_numpy(zero_copy_only=False) & used
        word, marks = (pc.struct_field(found, k).filter(pa.array(plain)) for k in ("word", "marks"))
        word, marks = (word if self.leading_space else pc.utf8_lower(word)).dictionary_encode(), marks.dictionary_encode()
        other = distinct.filter(pa.array(used & ~plain)).to_numpy(zero_copy_only=False).tolist()
        prefix = " " if self.leading_space else ""
        self._known(self.inner, other, prefix)
        pool = [self._word(w, self.leading_space) for w in word.dictionary.to_numpy(zero_copy_only=False).tolist()]
        at_marks = len(pool)
        pool += [self._mark(m) for m in marks.dictionary.to_numpy(zero_copy_only=False).tolist()]
        at_other = len(pool)
        pool += [self.inner[p] for p in other]
        pool.append(b"")
        size = np.fromiter(map(len, pool), np.int64, len(pool)) // 4
        first, second = np.full(len(distinct), len(pool) - 1), np.full(len(distinct), len(pool) - 1)
        first[plain], second[plain] = word.indices.to_numpy(), marks.indices.to_numpy() + at_marks
        first[used & ~plain] = at_other + np.arange(len(other))
        parts = np.stack([first, second], axis=1).reshape(-1)
        flat = _gather(np.frombuffer(b"".join(pool), "<u4"), (np.cumsum(size) - size)[parts], size[parts])
        return flat, size[first] + size[second]

    def _known(self, cache: dict[str, bytes], wanted: list[str] | set[str], prefix: str) -> None:
        self._learn(cache, [p for p in wanted if p not in cache], prefix)

    def _uneven(self, text: str) -> bytes:
        """A text with white space other than single spaces and line feeds between words."""
        cut, head = _LONE_SPACE.split(text), b""
        if self.leading_space:
            first = cut.pop(0)
            self._known(self.first, {first}, "")
            head = self.first[first]
        self._known(self.inner, set(cut), " " if self.leading_space else "")
        return head + b"".join(map(self.inner.__getitem__, cut))
