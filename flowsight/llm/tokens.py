"""Token ids of whole texts by a public tokenizer, with the ids of frequent words remembered per worker."""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

#: White space by Unicode's definition, which tokenizer patterns use too.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+$")

#: Letters beside ASCII that no library sees differently, and pieces made of such characters alone.
_LATIN = "À-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"[ \n]?[!-~{_LATIN}]+")
_LETTERS, _MARKS = f"[A-Za-z{_LATIN}]+", f"[^\\s\\x00A-Za-z0-9{_LATIN}]+"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"

#: What the two kinds of vocabulary files that have a fast path say about cutting texts.
_BYTE_CUT = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_WORD_CUT = _ENDINGS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def _kind(settings: dict) -> str | None:
    """byte or word if a file is of a kind with a fast path."""
    if settings["normalizer"] is None and settings["pre_tokenizer"] == _BYTE_CUT:
        return "byte"
    if settings["model"].get("end_of_word_suffix") == "</w>" and _WORD_CUT in json.dumps(settings["pre_tokenizer"]).replace("\\\\", "\\"):
        return "word"
    return None


class _Fast:
    """Ids of plain pieces, many in one call: cut and mapped to the byte alphabet here, merged by the library's model.

    The tokenizer's own cutting by patterns costs more than its merging. The model gets the cuts of many pieces in one
    string, separated by blanks, which the byte alphabet does not have; the lengths of the tokens tell where a piece ends.
    """

    def __init__(self, settings: dict, kind: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        model = settings["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # What comes here is new, so the model's own cache would only cost time.
        suffix = {"end_of_word_suffix": model["end_of_word_suffix"]} if kind == "word" else {}
        self.tokenizer = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, **suffix))
        self.tokenizer.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.lower = kind == "word"
        first, digits, blank = ("", "[0-9]", "") if self.lower else (" ?", " ?[0-9]+", "|\\n")
        self.cuts = re.compile(f"{_ENDINGS}|{first}{_LETTERS}|{digits}|{first}{_MARKS}{blank}")
        alphabet = _byte_alphabet()
        chars = [chr(c) for c in (10, *range(0x20, 0x7F), *range(0xC0, 0x100))]
        self.mapped = str.maketrans({c: "".join(alphabet[b] for b in c.encode()) for c in chars} | {"\0": " "})
        self.sizes = np.zeros(max(model["vocab"].values()) + 1, dtype=np.int64)
        for token, number in model["vocab"].items():
            self.sizes[number] = len(token.removesuffix("</w>") if self.lower else token)

    def encode(self, pieces: list[str]) -> list[bytes]:
        """The ids of plain pieces as bytes of unsigned 32-bit integers."""
        texts, ends = [], []
        for at in range(0, len(pieces), 500):
            part = [p.lower().lstrip(" \n") for p in pieces[at : at + 500]] if self.lower else pieces[at : at + 500]
            texts.append("\0".join(self.cuts.findall("\0".join(part))).translate(self.mapped))
            ends.append(np.cumsum([len(p.encode()) for p in part]))
        found = []
        for encoding, to in zip(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), ends):
            ids = np.array(encoding.ids, dtype=np.uint32)
            stops = (np.searchsorted(np.cumsum(self.sizes[ids]), to) + 1) * 4
            data, start = ids.tobytes(), 0
            for stop in stops.tolist():
                found.append(data[start:stop])
                start = stop
        return found


class Encoder:
    """Ids of texts, the same as those of Tokenizer.encode(text, add_special_tokens=False).

    A text is cut before white space that follows another character. Pre-tokenizers that treat white space as a
    border never join what lies on both sides of such a cut, so the ids of a text are those of its pieces in order. The
    ids of up to `remembered` pieces of at most 64 characters stay in memory; what is not remembered is encoded
    again, so results do not depend on it.
    """

    def __init__(self, path: str, remembered: int = 600_000):
        # One task has one core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        settings = json.loads(self.tokenizer.to_str())
        kind = _kind(settings)
        self.fast = _Fast(settings, kind) if kind else None
        self.known: dict[str, bytes] = {}
        self.remembered = remembered

    def _encode(self, pieces: list[str]) -> dict[str, bytes]:
        plain, others = [], pieces
        if self.fast:
            plain = [p for p in pieces if _PLAIN.fullmatch(p)]
            others = [p for p in pieces if not _PLAIN.fullmatch(p)] if len(plain) < len(pieces) else []
        found = dict(zip(plain, self.fast.encode(plain))) if plain else {}
        for piece, encoding in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            found[piece] = np.array(encoding.ids, dtype=np.uint32).tobytes()
        return found

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers."""
        cut = [_PIECES.findall(text) for text in texts]
        known = self.known
        room = self.remembered - len(known)
        missing = [piece for piece in dict.fromkeys(chain.from_iterable(cut)) if piece not in known]
        for at in range(0, len(missing), 20_000):
            known.update(self._encode(missing[at : at + 20_000]))
        found = [np.frombuffer(b"".join(map(known.__getitem__, pieces)), dtype=np.uint32) for pieces in cut]
        for piece in missing:
            if room > 0 and len(piece) <= 64:
                room -= 1
            else:
                del known[piece]
        return found


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, loaded once per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
