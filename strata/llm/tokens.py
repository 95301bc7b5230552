"""Token ids of whole texts under a byte-level BPE vocabulary file.

The file is read by tokenizers; the merging itself runs in tiktoken on ranks made from the same file, at about five times
the speed. Both give the same ids where each merge makes a token of its own, in the order of the ids, and each token
comes back whole when encoded alone: a span that turns into a token by some merge has then turned into it by its own
merges, as nothing has crossed its ends before. ``Encoder`` checks the first on loading, the tests the second. Texts
with the special token's string or with characters whose class could differ between two versions of Unicode, and
vocabularies that fail the check, go through tokenizers.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: How byte-level vocabularies cut texts into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What tokenizers must do itself: all but long settled letters and signs (Latin, Greek, Cyrillic, punctuation, kana, Han,
#: Hangul), and white space on both sides of a space, where a cut at the space could change pieces.
_SLOW = r"[^\x00-\x1b\x20-\x7f\x{a1}-\x{52f}\x{2010}-\x{2027}\x{2030}-\x{205e}€\x{3041}-\x{3096}\x{30a1}-\x{30fa}\x{4e00}-\x{9fa5}\x{ac00}-\x{d7a3}]|[ \t-\r] [ \t-\r]|[ \t-\r]{500}"
_loaded: dict[str, "Encoder"] = {}


def _bytes_of() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            layout = json.load(file)
        model, cut = layout["model"], layout["pre_tokenizer"] or {}
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not layout["normalizer"]
        self.fast = None
        names = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))
        self.opens = np.array([(name or "").startswith("Ġ") for name in names])  # byte-level vocabularies write a space so
        if plain and all(a < b for a, b in zip(made, made[1:])):
            letters = _bytes_of()
            ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
            self.fast = tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of words behind a space; those without white space are encoded as one text."""
        plain = pc.match_substring_regex(words, r"^[^ \t-\r]+$").to_numpy(zero_copy_only=False)
        line = " ".join(["", *words.filter(pa.array(plain)).to_pylist()])
        line = np.array(self.fast.encode_ordinary(line) if plain.any() else [], "<u4")
        at = np.flatnonzero(self.opens[line])  # each word starts at the only token that opens with a space
        lengths = np.zeros(len(words), np.int64)
        lengths[plain] = np.diff(np.append(at, len(line)))
        rest = [self.fast.encode_ordinary(f" {words[int(k)]}") for k in np.flatnonzero(~plain)]
        lengths[~plain] = [len(x) for x in rest]
        ids = np.empty(int(lengths.sum()), "<u4")
        where = np.repeat(plain, lengths)
        ids[where], ids[~where] = line, [i for x in rest for i in x]
        return ids, lengths

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text (null: none). Texts are cut at their spaces and each different word is merged once."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        slow = pc.match_substring_regex(texts, _SLOW).to_numpy(zero_copy_only=False) if self.fast else np.ones(len(texts), bool)
        for s in self.special:
            slow = slow | pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        for k in np.flatnonzero(slow):
            out[k] = np.array(self.tokenizer.encode_batch_fast([texts[int(k)].as_py()], add_special_tokens=False)[0].ids, "<u4")
        if slow.all():
            return out
        pieces = pc.split_pattern(texts.filter(pa.array(~slow)), " ")
        first = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        coded = pieces.flatten().dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        heads = [self.fast.encode_ordinary(words[int(k)].as_py()) for k in code[first[:-1]]]  # no space stands before these
        code[first[:-1]] = len(words) + np.arange(len(heads))
        ids, lengths = self._plain(words)
        ids = np.concatenate([ids, np.array([i for x in heads for i in x], "<u4")])
        lengths = np.append(lengths, [len(x) for x in heads]).astype(np.int64)
        each = lengths[code]
        ends = np.cumsum(each)
        every = ids[np.repeat((np.cumsum(lengths) - lengths)[code] - (ends - each), each) + np.arange(int(ends[-1]))]
        cuts = np.append(0, ends)[first]
        for k, i, j in zip(np.flatnonzero(~slow), cuts, cuts[1:]):
            out[k] = every[i:j]
        return out

    def ids(self, text: str) -> np.ndarray:
        return self.encode(pa.array([text]))[0]


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
