"""Token ids of whole texts with the tokenizers library, as small-endian bytes.

The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)`` of the file as it is loaded. For a file of the
kind that ``WordEncoder`` checks for, texts of the first 256 characters of Unicode are split by the file's own rule over
Arrow buffers, a worker keeps the ids of the pieces it has met, and new pieces go to the library many at a time. Any
other text is cut at white space, which such a file never joins characters across, and each word with other characters
goes to the library whole. Texts that hold one of the file's special strings, or a control character that Python and the
library split differently, and all texts of other files, are encoded whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

END = 1
#: Pieces kept by a worker before it starts afresh, and characters handled at once. Neither changes a result.
KEPT, AT_ONCE = 600_000, 1 << 20
_ODD = re.compile("[\x1c-\x1f]")
# What the file's rule for a split says.
RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACES, DIGITS = "\t\n\x0b\x0c\r \x85\xa0", "0123456789²³¹¼½¾"
LETTERS = "abcdefghijklmnopqrstuvwxyzªµºßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
SPACE, LETTER, DIGIT, SYMBOL = range(4)
KIND = np.full(256, SYMBOL, np.uint8)
for _kind, _chars in ((SPACE, SPACES), (LETTER, LETTERS), (DIGIT, DIGITS)):
    KIND[list(_chars.encode("latin-1"))] = _kind


def split(data: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Pieces of lower-cased Latin-1 bytes by RULE: (first bytes, pieces). White space alone lies between pieces."""
    n = len(data)
    kind = KIND[data]
    edge = np.ones(n + 3, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[:n] |= kind == DIGIT
    q = np.flatnonzero((data == 39) & edge[:n])  # an apostrophe that does not follow a mark
    if len(q):
        after = np.append(data, np.zeros(3, np.uint8))
        a, b = after[q + 1], after[q + 2]
        one = np.isin(a, list(b"stmd"))
        two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
        edge[q[one] + 2], edge[q[two] + 3] = True, True
        edge[q[one | two] + 1] = False
    solid = kind != SPACE
    first = np.flatnonzero(edge[:n] & solid)
    body = data[solid]
    place = np.cumsum(solid, dtype=np.int32)
    offsets = np.append(place[first] - 1, len(body)).astype(np.int32)
    return first, pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(body)])


class WordEncoder:
    """ids(texts): for each text its ids, unsigned 32-bit little-endian bytes, without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        split = spec.get("pre_tokenizer") or {}
        steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        parts = split.get("pretokenizers", [])
        suffix = spec["model"].get("end_of_word_suffix")
        vocab = self.library.get_vocab(with_added_tokens=True)
        alphabet = pre_tokenizers.ByteLevel.alphabet()
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.by_word = (
            steps == ["NFC", "Replace", "Lowercase"]
            and [p.get("type") for p in parts] == ["Split", "ByteLevel"]
            and parts[0].get("pattern") == {"Regex": RULE}
            and not parts[1].get("add_prefix_space")
            and spec["model"]["type"] == "BPE"
            and not spec["model"].get("dropout")
            and bool(suffix)
            and all(c in vocab and c + suffix in vocab for c in alphabet)
            and not any(t["normalized"] for t in spec["added_tokens"])
        )
        if self.by_word:
            # pieces are split and normalised already: between spaces they need the file's model alone
            self.pieces = Tokenizer.from_file(path)
            self.pieces.normalizer = normalizers.Sequence([])
            self.pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        #: Number of each known piece; where its ids begin in ``flat``, one more for the end of the last.
        self.words: dict[bytes, int] = {}
        self.at, self.flat = np.zeros(1, np.int64), np.empty(0, np.uint32)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        encode = getattr(self.library, "encode_batch_fast", self.library.encode_batch)  # without offsets
        return [np.array(e.ids, "<u4") for e in encode(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        """Ids of pieces: each ends with the one token that ends a word."""
        encode, found = getattr(self.pieces, "encode_batch_fast", self.pieces.encode_batch), []
        for i in range(0, len(new), 4096):
            found += encode([b" ".join(new[i : i + 4096]).decode("latin-1")], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in found])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(new):
            raise ValueError("pieces and their ids do not match")
        self.words.update(zip(new, range(len(self.words), len(self.words) + len(new))))
        self.at = np.concatenate([self.at, ends + len(self.flat)])
        self.flat = np.concatenate([self.flat, ids])

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts of Latin-1 characters."""
        if len(self.words) > KEPT:
            self._forget()
        data = np.frombuffer("\n".join(texts).lower().encode("latin-1"), np.uint8)
        first, pieces = split(data)
        if not len(first):
            return [np.empty(0, "<u4")] * len(texts)
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist
        new = list(set(names).difference(self.words))
        if new:
            self._learn(new)
        which = np.fromiter(map(self.words.__getitem__, names), np.int64, len(names))[coded.indices.to_numpy()]
        size = self.at[which + 1] - self.at[which]
        ends = np.append(0, np.cumsum(size))
        ids = self.flat[np.repeat(self.at[which] - ends[:-1], size) + np.arange(ends[-1])]
        bounds = np.cumsum([len(t) + 1 for t in texts])
        cuts = ends[np.searchsorted(first, bounds)].tolist()
        return [ids[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]

    def _parts(self, text: str):
        """text in pieces of about AT_ONCE characters, cut at white space."""
        at = 0
        while len(text) - at > AT_ONCE:
            m = re.compile(r"\s").search(text, at + AT_ONCE)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def ids(self, texts: list[str | None]) -> list[bytes]:
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held, size = [], 0

        def flush():
            for (i, _), x in zip(held, self._plain([t for _, t in held])):
                out[i].append(x)
            held.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.by_word or any(s in text for s in self.special):
                out[i] += self._encode([text])
            elif not _latin(text):
                out[i] += self._encode([text]) if _ODD.search(text) else self._by_word(text)
            else:
                for part in self._parts(text):
                    held.append((i, part))
                    size += len(part)
                    if size > AT_ONCE:
                        flush()
                        size = 0
        if held:
            flush()
        return [x[0].tobytes() if len(x) == 1 else b"".join(map(bytes, x)) for x in out]

    def _by_word(self, text: str) -> list[np.ndarray]:
        """Ids of a text with characters beyond the first 256: only the words that have them go to the library whole."""
        out = []
        for part in self._parts(text):
            words = part.split()
            kinds = list(dict.fromkeys(words))
            plain, odd = [w for w in kinds if _latin(w)], [w for w in kinds if not _latin(w)]
            known = dict(zip(odd, self._encode(odd)))
            if plain:
                known.update(zip(plain, self._plain(plain)))
            out += map(known.__getitem__, words)
        return out


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    """One encoder a worker and file."""
    return WordEncoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
