"""Token ids by a `tokenizers` file, word by word.

Text between white space is encoded on its own: tokenizers of this kind (white space dropped
before the pieces are cut) never look across it, and test that on loading. A bounded
dictionary per worker remembers the ids of words, so that the library only sees new words.
"""

import hashlib
import re

import numpy as np

from reporank.llm.common import worker_wide

WORDS_HELD = 400_000
#: Words of small ASCII letters and letters of Latin-1 as UTF-8: one piece each, in normal form.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
PROBES = (
    "A b", "a  b\tc\n", " x's y 's 12 ab12 ...", "été é ́ aΣ Σ", "<|endoftext|> a<|startoftext|>b",
    "#!? ,. a.b,c", "中文 İ ﬁ",
)


def content_digest(path):
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class WordIds(dict):
    """Bytes of little-endian unsigned ids by word (bytes without ASCII white space)."""

    def __init__(self, path):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.lowers = self.whole("AZ") == self.whole("az")
        self.letters = self._letters()
        self.simple = self._letters_are_model_input()
        self.marks = {m: self.whole(m.decode()) for m in (b",", b".", b";", b":", b"!", b"?")}
        self.by_word = all(self.whole(p) == b"".join(map(self.__getitem__, p.encode().split())) for p in PROBES)
        self.clear()

    def whole(self, text):
        """As the library gives them for the whole text."""
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype=self.kind).tobytes()

    def _letters(self):
        """What the library makes of each letter of Latin-1 before the model sees it."""
        small = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
        pieces = (self.tokenizer.pre_tokenizer.pre_tokenize_str(c) for c in small)
        return {ord(c): own[0][0] for c, own in zip(small, pieces) if len(own) == 1}

    def _letters_are_model_input(self):
        """Whether words of letters reach the model as they are, but for the letters' spelling."""
        probes = ("a", "the", "qzxv", "internationalisation", "erstsh", "é", "übergrößeñ", "ÄÖçàÿß")
        return all(self._model(w) == self.whole(w) for w in probes)

    def _model(self, word):
        spelled = word.lower().translate(self.letters)
        return np.array([t.id for t in self.tokenizer.model.tokenize(spelled)], dtype=self.kind).tobytes()

    def __missing__(self, word):
        if self.simple and LETTERS.fullmatch(word):
            ids = self._model(word.decode())
        elif self.simple and word[-1:] in self.marks and LETTERS.fullmatch(word, 0, len(word) - 1):
            ids = self[word[:-1]] + self.marks[word[-1:]]
        else:
            ids = self.whole(word.decode())
        if len(self) >= WORDS_HELD:
            self.clear()
        self[word] = ids
        return ids

    def ids(self, text):
        """Ids of a whole text as bytes of `kind`."""
        if not self.by_word:
            return self.whole(text)
        data = text.encode()
        if self.lowers and b"<" not in data:  # special strings are matched before lower-casing
            data = data.lower()
        return b"".join(map(self.__getitem__, data.split()))


def word_ids(path) -> WordIds:
    return worker_wide(f"word_ids_{hashlib.md5(path.encode()).hexdigest()}", lambda: WordIds(path))
