"""Quality rules: counts of a text, and how well public vocabularies fit it.

Each word is cut into tokens of two public vocabularies, one of pieces with
byte fallback and one of byte pairs for many languages. Characters per token
and the entropy of a text's tokens, of either, must lie in bands, and the share
of byte-fallback tokens below a bound. Two bands hold:

* wide fixed ones of the text's main script (``BANDS``), and
* ones fitted to the given texts themselves (``fitted_bands``). Both measures
  shift with language and length, so a band belongs to a language (the script
  where ``lang`` is null or missing) and to texts of about as many tokens: the
  median of the different texts that pass the base rules, ``WIDTH`` robust
  standard deviations to each side. A class of fewer than ``MIN_TEXTS`` texts
  has the fixed bands alone.

The base rules reject texts of under ``min_words`` words and texts of which
over half the words lie in repeated three-word windows.

Words are runs of characters other than ASCII white space. Defined cases: a
null or empty text has no words, no tokens and fails; repeated rows give one
row each and count once in the bands; an empty table gives no rows; extra
columns are ignored. Names in ``keep`` must differ from the result's own, which
``prefix`` can set apart.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.shared import slices, stored, texts_of

MIN_WORDS = 50
#: Words kept in one worker with their tokens; the cache starts anew beyond it, which changes no result.
CACHE_WORDS = 120_000
#: First code point of each range of scripts, and what it is.
_SCRIPT_STARTS = ((0x0, "none"), (0x41, "latin"), (0x5B, "none"), (0x61, "latin"), (0x7B, "none"), (0xAA, "latin"), (0x2B0, "none"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "none"), (0x2C00, "other"), (0x3040, "cjk"), (0xA000, "other"), (0xAC00, "cjk"), (0xD7B0, "none"), (0xF900, "cjk"), (0xFB00, "other"), (0x20000, "cjk"), (0x33480, "none"))
#: By script: characters per token at least and at most, byte share at most, bits of entropy at least.
BANDS = {
    "latin": (1.45, 9.0, 0.15, 5.2),
    "greek": (0.9, 9.0, 0.3, 4.6),
    "cyrillic": (1.2, 9.0, 0.2, 4.8),
    "cjk": (0.3, 4.0, 0.95, 4.4),
    "other": (0.2, 9.0, 1.0, 3.6),
    "none": (0.9, 9.0, 0.5, 4.0),
}
#: Robust standard deviations on each side of a fitted band's median, and the least one as a share of the median.
WIDTH, LEAST_DEVIATION = 4.0, 0.015
#: Different texts that a fitted band needs.
MIN_TEXTS = 50
#: Measures that have fitted bands: characters per token and entropy, of either vocabulary.
FITTED = ("chars_per_token", "token_entropy", "chars_per_token_2", "token_entropy_2")
MEASURED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, script string, n_tokens long, chars_per_token double, byte_share double, token_entropy double, n_tokens_2 long, chars_per_token_2 double, token_entropy_2 double, fixed_reason string"
#: Bands that are broadcast at most; more are joined by their class.
BROADCAST_BANDS = 10_000
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_STARTS = np.array([a for a, _ in _SCRIPT_STARTS], np.uint32)
_SCRIPTS = sorted({s for _, s in _SCRIPT_STARTS} - {"none"})
_SCRIPT_OF = np.array([_SCRIPTS.index(s) if s != "none" else len(_SCRIPTS) for _, s in _SCRIPT_STARTS])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def script_of(text: str) -> str:
    """The script of most letters; ties go to the first name; no letter gives none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.bincount(_SCRIPT_OF[np.searchsorted(_STARTS, points, side="right") - 1], minlength=len(_SCRIPTS) + 1)[:-1]
    return _SCRIPTS[int(counts.argmax())] if counts.any() else "none"


def second_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class WordTokens:
    """Packed ids of words; a word's tokens do not depend on its neighbours."""

    def __init__(self, path: str):
        if path.endswith(".tiktoken"):
            import base64

            import public_tokenizers
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            one = tiktoken.Encoding("driftline", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self._encode = lambda words: [one(" " + w) for w in words]
            self.is_byte = np.zeros(len(ranks), bool)
        else:
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self._encode = lambda words: model.encode(words, num_threads=1)
            self.is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())], bool)
        self._known: dict[bytes, bytes] = {}

    def of(self, texts_words: list[list[bytes]]) -> list[np.ndarray]:
        known = self._known
        if len(known) > CACHE_WORDS:
            known.clear()
        new = [w for w in set().union(*texts_words) if w not in known]
        known.update(zip(new, (array("I", ids).tobytes() for ids in self._encode([w.decode("utf-8", "replace") for w in new]))))
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint32) for words in texts_words]


@lru_cache(maxsize=4)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def repeated_words(words: list) -> int:
    """Words in three-word windows that occur twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, total = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(covered, i)
            covered = i + 3
    return total


def repeated_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    return len(lines) - len(set(lines))


def entropy(ids: np.ndarray) -> float:
    """Bits per token of a text's own token frequencies."""
    if not len(ids):
        return 0.0
    counts = np.unique(ids, return_counts=True)[1] if len(ids) < 8192 else np.bincount(ids)
    share = counts[counts > 0] / len(ids)
    return float(-(share * np.log2(share)).sum())


def _measured(text: str, words: list[bytes], ids: np.ndarray, second: np.ndarray, is_byte: np.ndarray, bands: dict[str, tuple], min_words: int) -> tuple:
    """Counts, measures and the verdict of the fixed rules, in the order of ``MEASURED``."""
    chars = len(text) - sum(map(text.count, _SPACES))
    repeats = repeated_words(words)
    base_failed = len(words) < min_words or 100 * repeats > 50 * len(words)
    script = script_of(text)
    n, n_2 = len(ids), len(second)
    per_token, byte_share, bits = (chars / n, float(is_byte[ids].mean()), entropy(ids)) if n else (0.0, 0.0, 0.0)
    least, most, bytes_most, bits_least = bands[script]
    reason = "base" if base_failed else "chars_per_token" if not least <= per_token <= most else "byte_share" if byte_share > bytes_most else "token_entropy" if bits < bits_least else None
    return len(words), chars, sum(map(text.count, _SYMBOLS)), repeated_lines(text), repeats, base_failed, script, n, per_token, byte_share, bits, n_2, chars / n_2 if n_2 else 0.0, entropy(second), reason


def measure(docs: DataFrame, *keep: str, vocabulary: str | None = None, second: str | None = None, bands: dict[str, tuple] | None = None, min_words: int = MIN_WORDS, prefix: str = "") -> DataFrame:
    """The columns ``keep`` of each document, and behind ``prefix`` those of ``MEASURED``."""
    bands = bands or BANDS
    fields = [(prefix + n, t) for n, t in (part.split() for part in MEASURED.split(", "))]
    arrow = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = word_tokens(vocabulary or default_path()), word_tokens(second or second_path())
        for batch in slices(batches):
            texts = texts_of(batch)
            words_of = [t.encode().split() for t in texts]
            rows = [_measured(text, words, a, b, one.is_byte, bands, min_words) for text, words, a, b in zip(texts, words_of, one.of(words_of), two.of(words_of))]
            found = [pa.array(c, arrow[t]) for c, (_, t) in zip(zip(*rows), fields)] if rows else [pa.array([], arrow[t]) for _, t in fields]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *found], names=[*keep, *(n for n, _ in fields)])

    schema = docs.select(*keep).schema
    for field in fields:
        schema = schema.add(*field)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def fitted_bands(measured: DataFrame, group: str, size: str, prefix: str = "", width: float = WIDTH, min_texts: int = MIN_TEXTS) -> DataFrame:
    """(group, size, and low and high of each measure of ``FITTED``) of the classes with enough different texts."""
    texts = measured.filter(~F.col(f"{prefix}base_failed")).select(group, size, *[prefix + c for c in FITTED]).distinct()
    quartiles = texts.groupBy(group, size).agg(F.count("*").alias(f"{prefix}n"), *[F.percentile_approx(prefix + c, [0.25, 0.5, 0.75], 10_000).alias(f"{prefix}{c}_q") for c in FITTED]).filter(F.col(f"{prefix}n") >= min_texts)
    out = [group, size]
    for c in FITTED:
        q = F.col(f"{prefix}{c}_q")
        reach = width * F.greatest((q[2] - q[0]) / 1.349, LEAST_DEVIATION * q[1])
        out += [(q[1] - reach).alias(f"{prefix}{c}_low"), (q[1] + reach).alias(f"{prefix}{c}_high")]
    return quartiles.select(*out)


def judge(docs: DataFrame, *keep: str, min_words: int = MIN_WORDS, prefix: str = "", **options) -> DataFrame:
    """The columns ``keep`` of each document and behind ``prefix`` its counts and measures, ``kept``, and the first ``reason`` against it.

    ``options`` are those of ``measure``.
    """
    own = f"{prefix or '_'}band_"
    language = [F.col("lang").cast("string").alias(f"{own}lang")] if "lang" in docs.columns else []
    rows = docs.select(*keep, *([] if "text" in keep else ["text"]), *language)
    found = measure(rows, *keep, *([f"{own}lang"] if language else []), min_words=min_words, prefix=prefix, **options)
    group = F.coalesce(*([f"{own}lang"] if language else []), f"{prefix}script")
    size = F.floor(F.log2(F.greatest(F.col(f"{prefix}n_tokens"), F.lit(1)))).cast("int")
    found = stored(found.withColumns({f"{own}group": group, f"{own}size": size}))
    bands = stored(fitted_bands(found, f"{own}group", f"{own}size", prefix))
    few = bands.count() <= BROADCAST_BANDS
    found = found.join(F.broadcast(bands) if few else bands, [f"{own}group", f"{own}size"], "left")
    outside = lambda c: (F.col(prefix + c) < F.col(f"{prefix}{c}_low")) | (F.col(prefix + c) > F.col(f"{prefix}{c}_high"))
    reason = F.coalesce(f"{prefix}fixed_reason", *[F.when(outside(c), F.lit(c.removesuffix("_2"))) for c in FITTED])
    names = [prefix + part.split()[0] for part in MEASURED.split(", ")]
    return found.select(*keep, *names[:6], reason.isNull().alias(f"{prefix}kept"), *names[6:-1], reason.alias(f"{prefix}reason"))
