"""Token ids of whole texts, through a cache of words."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

from .common import release
from .hashing import BYTE_VALUES, POWERS, WORD_BASE, mix

#: Words whose ids a worker remembers, some 50 bytes each: beyond, those that were not met for longest are forgotten.
CACHE_WORDS = 700_000
#: Characters of the texts that are numbered together.
TEXT_CHARS = 6_000_000
VOCABULARY = "word_bpe_49k.json"
#: A full stop or comma that belongs to a longer run of signs, which the splitter keeps as one.
SIGN_RUN = re.compile(r"[.,](?<=[^\w\s][.,]|_[.,]) ")
#: The vocabulary file's splitter, and its form for words of ``PLAIN`` characters in small letters.
SPLITTER = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: Words that are hashed together, and words that the library is given in one text.
HASHED, JOINED = 50_000, 2000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def hashes_of(words: pa.Array) -> np.ndarray:
    """A 64-bit value for each of ``words``, by its bytes."""
    out = [np.empty(0, np.uint64)]
    for i in range(0, len(words), HASHED):
        part = words.slice(i, HASHED)
        ends = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        a = np.frombuffer(part.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        up, down = POWERS.upto(len(a) + 1)
        total = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[a] * up[: len(a)], out=total[1:])
        first, end = ends[:-1] - ends[0], ends[1:] - ends[0]
        out.append(mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64) * WORD_BASE))
    return np.concatenate(out)


class WordTokenizer:
    """The ids that ``Tokenizer.encode(text, add_special_tokens=False)`` gives, without its work on known words.

    The vocabulary file's splitter never joins characters across a blank or line feed, its normaliser acts on
    each character, and its special tokens hold no blank, so the ids of a text are those of its parts between
    blanks and line feeds, in order. Each new part is given to the library; the ids of parts are remembered.
    In Latin-1 text without special tokens, case is folded and a stop or comma after a letter or digit stands
    apart, as the normaliser and the splitter would have it: so far fewer parts are new. New parts of plain letters,
    digits and signs go to the library's model as the splitter would cut them, many in one text. Known parts are
    found by hash and compared.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.small = self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16
        self.kind = np.uint16 if self.small else np.uint32
        suffix = self.tokenizer.model.end_of_word_suffix or "\0"
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        #: by id, whether the token ends a word
        self.ends = np.array([t.endswith(suffix) for t in tokens], bool)
        self.pieces = self.by_pieces()
        self.clock, self.most = 0, CACHE_WORDS
        self.forget()

    def by_pieces(self) -> Tokenizer | None:
        """The same model for pieces between blanks, where the file normalises and splits as ``PIECE`` does and marks the
        ends of words; None for other files."""
        steps = json.loads(self.tokenizer.to_str())
        norm, split = ((steps[k] or {}).get(v) or [] for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        known = [x["type"] for x in norm] == ["NFC", "Replace", "Lowercase"] and norm[1].get("pattern") == {"Regex": "\\s+"} and norm[1].get("content") == " "
        known = known and [x["type"] for x in split] == ["Split", "ByteLevel"] and split[0].get("pattern") == {"Regex": SPLITTER} and (split[0].get("behavior"), split[0].get("invert")) == ("Removed", True)
        if not known or not self.ends.any() or split[1].get("add_prefix_space") or split[1].get("use_regex") or not all(t["content"].startswith("<|") for t in steps["added_tokens"]):
            return None
        out = Tokenizer(self.tokenizer.model)
        out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return out

    def forget(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.size = self.first = self.met = np.empty(0, np.int32)
        self.flat = np.empty(0, self.kind)
        #: the known words' hashes in order, and their places
        self.hashes, self.order = np.empty(0, np.uint64), np.empty(0, np.int32)

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of new words, by the library: in which order, their ids one after another, and how many each has."""
        plain = np.array([self.pieces is not None and PLAIN.fullmatch(w) is not None and "<|" not in w for w in words], bool)
        order = np.argsort(~plain, kind="stable")
        count = int(plain.sum())
        flat, size = [], [np.empty(0, np.int64)]
        for i in range(0, count, JOINED):
            part, number = [], []
            for j in order[i : min(i + JOINED, count)].tolist():
                w = words[j].lower()
                cut = [w] if w.isalpha() else PIECE.findall(w)
                part += cut
                number.append(len(cut))
            # a piece's last id says so; the ids of a word are those of its pieces
            ids = np.array(self.pieces.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            end = np.flatnonzero(self.ends[ids]) + 1
            if len(end) != len(part) or end[-1] != len(ids):
                raise ValueError("the tokenizer does not keep words apart")
            flat.append(ids)
            size.append(np.diff(end[np.cumsum(number) - 1], prepend=0))
        for i in range(count, len(words), JOINED):
            got = self.tokenizer.encode_batch_fast([words[j] for j in order[i : i + JOINED].tolist()], add_special_tokens=False)
            flat += [np.array(x.ids, self.kind) for x in got]
            size.append(np.array([len(x.ids) for x in got], np.int64))
        return order, np.concatenate([np.empty(0, self.kind), *flat]), np.concatenate(size)

    def lookup(self, words: pa.Array) -> np.ndarray:
        """The places of distinct words among the known ones; the new ones are learnt together."""
        self.clock += 1
        if len(self.words) + len(words) > max(self.most, 2 * len(words)):
            keep = np.sort(np.argsort(-self.met, kind="stable")[: self.most // 2])
            each = self.size[keep]
            end = np.cumsum(each)
            flat = self.flat[np.repeat(self.first[keep] - (end - each), each) + np.arange(each.sum())]
            moved = np.full(len(self.words), -1, np.int32)
            moved[keep] = np.arange(len(keep))
            left = moved[self.order] >= 0
            self.hashes, self.order = self.hashes[left], moved[self.order[left]]
            self.words, self.size, self.first, self.met, self.flat = self.words.take(pa.array(keep)), each, (end - each).astype(np.int32), self.met[keep], flat
        hashes = hashes_of(words)
        place = np.full(len(words), -1, np.int32)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            maybe = np.flatnonzero(self.hashes[at] == hashes)
            found = self.order[at[maybe]]
            same = pc.equal(self.words.take(pa.array(found)), words.take(pa.array(maybe))).to_numpy(zero_copy_only=False)
            place[maybe[same]] = found[same]
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            new = words.take(pa.array(fresh))
            order, flat, size = self.learn(new.to_numpy(zero_copy_only=False).tolist())
            back = np.empty(len(order), np.int32)
            back[order] = np.arange(len(order))
            place[fresh] = len(self.words) + back
            self.words = pa.concat_arrays([self.words, new.take(pa.array(order))])
            self.first = np.concatenate([self.first, (len(self.flat) + np.cumsum(size) - size).astype(np.int32)])
            self.size, self.met = np.concatenate([self.size, size.astype(np.int32)]), np.concatenate([self.met, np.zeros(len(order), np.int32)])
            self.flat = np.concatenate([self.flat, flat])
            fresh = fresh[np.argsort(hashes[fresh], kind="stable")]
            at = np.searchsorted(self.hashes, hashes[fresh])
            self.hashes, self.order = np.insert(self.hashes, at, hashes[fresh]), np.insert(self.order, at, place[fresh])
        self.met[place] = self.clock
        return place

    def spaced(self, text: str | None) -> str:
        """``text`` with a blank between its parts."""
        text = (text or "").replace("\n", " ") + " "
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        if "<|" in text or SIGN_RUN.search(text):
            return text
        return text.lower().replace(". ", " . ").replace(", ", " , ")

    def ids_of(self, texts: list[str | None], chars: int = TEXT_CHARS) -> list[np.ndarray]:
        """The ids of each text. Parts are numbered once for many texts (of ``chars`` characters and the text that passes
        them), and only new ones become Python strings."""
        out: list[np.ndarray] = []
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(self.spaced(text))
            size += len(held[-1])
            if size > chars:
                out += self.numbered(held)
                held, size = [], 0
        return out + self.numbered(held) if held else out

    def numbered(self, spaced: list[str]) -> list[np.ndarray]:
        parts = pc.split_pattern(pa.array(spaced, pa.large_string()), " ")
        coded = parts.flatten().dictionary_encode()
        place = self.lookup(coded.dictionary)[coded.indices.to_numpy()]
        each = self.size[place]
        end = np.zeros(len(each) + 1, np.int32)
        np.cumsum(each, out=end[1:])
        at = np.repeat(self.first[place] - end[:-1], each)
        at += np.arange(end[-1], dtype=np.int32)
        ids = self.flat[at]
        offsets = parts.offsets.to_numpy()
        out = np.split(ids, end[offsets[1:-1] - offsets[0]])
        del parts, coded, place, each, end, at
        if len(ids) > TEXT_CHARS // 8:
            release()
        return out

    def ids(self, text: str | None) -> np.ndarray:
        return self.ids_of([text])[0]


_LOADED: dict[str, WordTokenizer] = {}


def load(path: str, words: int = CACHE_WORDS) -> WordTokenizer:
    """One tokenizer for each path and worker, which remembers so many words at least."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    _LOADED[path].most = max(_LOADED[path].most, words)
    return _LOADED[path]
