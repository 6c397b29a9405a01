"""Helpers shared by the corpus operators: shared storage, column selection, text tokens."""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import kept, shared_folder

#: Stands for a null document id inside the operators: such a row sorts after every real id.
NO_ID = 2**63 - 1


#: A table written once to the shared folder and read back: lineage is cut, lost executors lose nothing.
stored = kept


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder, for loops whose plans would grow."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def id_or_last(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def id_or_null(column: str = "doc_id") -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column))


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class TokenBytes(dict):
    """Word -> its token ids as little-endian uint32 bytes, filled on first use.

    Words are used for tokenizers that drop white space, lower-case, and part
    letters from punctuation, so that a text's ids are those of its words and of
    the single marks behind them, in order; PROBES tell at the start whether a
    tokenizer is one of them, and any other one encodes whole texts. Long words
    and words past the size limit are encoded each time and not kept.
    """

    PROBES = (
        "It's a,b. c.. Don't", " two  spaces, at both ends  ", "line\nbreaks,\n\nand\ttabs.\r\nend.", "ABC DeF É é ß ÀÇ. ñandú,", "12 3.5 x1 1,000 a-b (c) \"d\"",
        "a <|endoftext|> b <|END|>", "ǅ İ ſ ς Σ 安全 😀", "hello", " hello", "hello ", "", " ", "the the, The. THE", "x" * 50 + " " + "é" * 50, "\x0b\x1c\xa0 z",
    )

    def __init__(self, path: str, keep: int = 400_000, longest: int = 40):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.keep, self.longest = keep, longest
        self.mark = re.compile(r"(?<=[a-zß-öø-ÿ])[.,](?=[ \n])")
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_level = {c: shown.pre_tokenize_str(chr(c))[0][0] for c in range(128, 256)}
        # a lower-case word of Latin letters is one piece for the model, unless this tokenizer parts words otherwise
        self.one_piece = all(self.direct(w) == self.encode(w) for w in ("a", "thorn", "queue", "élève", "straße", "ñandú", "zzxqy"))
        self.by_word = True
        self.by_word = all(self.of(x) == self.whole(x) for x in self.PROBES)

    def encode(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def whole(self, text: str) -> bytes:
        return array("I", self.encode(text)).tobytes()

    def direct(self, word: str) -> list[int]:
        """The same by the model alone, without the steps that find and trim words."""
        return [t.id for t in self.tokenizer.model.tokenize(word if word.isascii() else word.translate(self.byte_level))]

    def __missing__(self, word: str) -> bytes:
        plain = self.one_piece and word.isalpha() and word.islower() and latin(word)
        out = array("I", self.direct(word)).tobytes() if plain else self.whole(word)
        if len(word) <= self.longest and len(self) < self.keep:
            self[word] = out
        return out

    def of(self, text: str) -> bytes:
        """The ids of a whole text. Only white space on which all tokenizers agree splits it."""
        if not self.by_word:
            return self.whole(text)
        return b"".join(b"".join(map(self.__getitem__, self.words(x))) for x in stretches(text))

    def words(self, text: str) -> list[str]:
        # lower-case here only where every library agrees; the tokenizer finds its special strings ("<|...|>") before it lower-cases
        if "<|" not in text and latin(text):
            text = self.mark.sub(r" \g<0>", text.lower())
        return text.replace("\n", " ").replace("\t", " ").split(" ")


def stretches(text: str, size: int = 1 << 15) -> Iterator[str]:
    """The text in stretches that end before a space, so that a very long one is not held as words all at once."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


#: Runs of digits, of letters in lower case and of bytes beyond ASCII, and A-Z to a-z.
LOWER_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWER_CASE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lower_words(text: str) -> Iterator[list[bytes]]:
    """The words of a text after A-Z have become lower case, as UTF-8, in lists of bounded stretches."""
    for part in stretches(text, 1 << 20):
        yield LOWER_WORD.findall(part.encode().translate(LOWER_CASE))


def latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> TokenBytes:
    """One per Python worker, kept between its tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return TokenBytes(path)


def word_tokenizer_path() -> str:
    """The vocabulary file of the public word-level BPE tokenizer on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
