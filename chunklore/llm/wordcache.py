"""Exact tokenization by distinct words.

Both vocabularies used here cut a text at certain blanks whatever stands around them, so
the ids of a text are those of its parts put together. Each worker keeps a bounded table of the parts it
has met; parts not in it, and texts where the cut isn't certain, go to the library itself.
"""

from __future__ import annotations

import json
import os
import struct
from unicodedata import is_normalized

#: Parts and stems that a worker remembers at most, and the characters of both.
KEEP, KEEP_CHARS = 450_000, 12_000_000
#: ASCII marks but the apostrophe: a word of letters surely ends before them.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The characters that byte-level vocabularies show bytes by: printable ones for themselves, the rest from 256 on.
_plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _plain)}

_loaded: dict[tuple[str, bool], object] = {}


def load(path: str, ordinary: bool = False):
    """The tokenizer of a file, once for each worker, on one thread. ordinary: special tokens' strings in a text are ordinary text."""
    if (path, ordinary) not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path, ordinary] = Tokenizer.from_file(path)
        _loaded[path, ordinary].encode_special_tokens = ordinary
    return _loaded[path, ordinary]


def packed(encoding) -> bytes:
    return struct.pack(f"<{len(encoding)}I", *encoding.ids)


class WordCache:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes.

    blanks_dropped: the vocabulary ignores white space (so any blank or newline is a certain cut); else a part starts
    with its blank, and only a single blank between two other characters is a certain cut.
    """

    def __init__(self, path: str, blanks_dropped: bool, keep: int = KEEP, ordinary: bool = False):
        self.tokenizer, self.blanks_dropped, self.known = load(path, ordinary), blanks_dropped, {}
        self.stems: dict[str, bytes] = {}
        self.chars, self.keep = 0, keep
        self.ends: dict[str, bool] = {}  # by character; Unicode bounds it

    def whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False))

    def ends_word(self, c: str) -> bool:
        """Whether the library, once it has normalised, takes the character as letters alone and cuts before a mark that follows it."""
        if c not in self.ends:
            normal, before = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
            left = normal.normalize_str(c) if normal else c
            cut = [part for part, _ in before.pre_tokenize_str(f"a{left}a.")]
            self.ends[c] = c.isalpha() and len(cut) == 2 and cut[1] == "."
        return self.ends[c]

    def learn(self, parts: set[str]) -> dict[str, bytes | None]:
        """Ids of these parts, and of others. A part is None where its cut isn't certain."""
        fresh: set[str] | list[str] = [p for p in parts if p not in self.known]
        if not fresh:
            return self.known
        if max(len(self.known), len(self.stems)) + len(fresh) > self.keep or self.chars > KEEP_CHARS:
            self.known = {}
            self.stems = {}
            self.chars, fresh = 0, parts
        known, stems, tokenize, slow = self.known, self.stems, self.tokenizer.model.tokenize, []
        dropped, lead = self.blanks_dropped, 0 if self.blanks_dropped else 1
        for p in fresh:
            if lead and not ((w := p[1:]) and w.strip() == w):
                known[p] = None
                continue
            stem = p.rstrip(MARKS)
            if not stem or not (stem[-1].isalpha() if stem.isascii() else self.ends_word(stem[-1])):
                slow.append(p)
                continue
            tail = p[len(stem) :]
            if dropped and stem.isascii():  # for ASCII alone Python's lower case is surely the library's
                stem = stem.lower()
            if (ids := stems.get(stem)) is None:
                # one run of letters, as the library's own steps leave it: its bytes go to the merges straight
                letters = stem[lead:]
                if letters.isalpha() and (letters.isascii() or (all(map(self.ends_word, set(letters))) and (not dropped or (letters == letters.lower() and is_normalized("NFC", letters))))):
                    shown = stem if dropped and letters.isascii() else stem.encode().decode("latin-1").translate(SHOWN)
                    got = tokenize(shown)
                    ids = struct.pack(f"<{len(got)}I", *[t.id for t in got])
                else:
                    ids = packed(self.tokenizer.encode(stem, add_special_tokens=False))
                stems[stem] = ids
            if tail:
                if (more := stems.get(tail)) is None:
                    more = stems[tail] = packed(self.tokenizer.encode(tail, add_special_tokens=False))
                ids += more
            known[p] = ids
        if slow:
            known.update(zip(slow, map(packed, self.tokenizer.encode_batch_fast(slow, add_special_tokens=False)), strict=True))
        self.chars += 2 * sum(map(len, fresh))
        return known

    def found(self, parts: list[str]) -> list[bytes | None]:
        got = list(map(self.known.get, parts))
        if None in got:
            known = self.learn({p for p, ids in zip(parts, got, strict=True) if ids is None})
            got = [known[p] if ids is None else ids for p, ids in zip(parts, got, strict=True)]
        return got

    def ids(self, texts: list[str]) -> list[bytes]:
        """For each whole text."""
        out = []
        for text in texts:
            if "<|" in text:
                out.append(self.whole(text))
            elif self.blanks_dropped:
                out.append(b"".join(self.found(text.replace("\n", " ").split(" "))))
            else:
                first, *parts = text.split(" ")
                got = self.found([" " + p for p in parts]) if first[-1:].strip() else [None]
                out.append(self.whole(text) if None in got else b"".join([self.whole(first), *got]))
        return out


_caches: dict[str, object] = {}


def encoder(path: str):
    """A function from a list of whole texts to their ids as little-endian unsigned 32-bit bytes: what the library of that kind of file gives."""
    if path in _caches:
        return _caches[path]
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = lambda texts: [struct.pack(f"<{len(x)}I", *x) for x in model.encode(texts, num_threads=1)]
    else:
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        before, normal = made.get("pre_tokenizer") or {}, made.get("normalizer")
        plain = made["model"]["type"] == "BPE" and not made["model"].get("dropout") and not made.get("truncation") and not made.get("padding")
        if plain and normal is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
            found = WordCache(path, False).ids
        elif plain and json.dumps(before.get("pretokenizers", [{}])[0]).find('"Removed", "invert": true') > 0 and {"Lowercase"} < {x["type"] for x in (normal or {}).get("normalizers", [])} <= {"NFC", "Replace", "Lowercase"}:
            found = WordCache(path, True).ids
        else:
            tokenizer = load(path)
            found = lambda texts: [packed(e) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    _caches[path] = found
    return found
