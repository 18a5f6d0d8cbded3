"""String expressions: white space, tokens, replacement chains, repairs. All are built-in expressions unless marked."""

from __future__ import annotations

import uuid
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Unicode and Python see it, in a form that Java's and RE2's regular expressions both read.
WS = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Characters at which a piece of text is cut into tokens.
SPLIT_CHARS = "][}{)(>< \n\t:;!.?_,¶§%&£€$¹°½¼¾©←→▪➢√|#–‒…·•@~\\/”“«»\"0123456789=*+‑-"


def split_class() -> str:
    """The characters as a class that Java's, Python's and RE2's regular expressions read."""
    names = {"\n": r"\n", "\t": r"\t"}
    return "[" + "".join(names.get(c, "\\" + c if c.isascii() and not c.isalnum() and c != " " else c) for c in SPLIT_CHARS) + "]"


def pieces(text: str | Column) -> Column:
    """Runs of non-space characters."""
    return F.filter(F.split(text, WS + "+"), lambda x: x != "")


def word_count(text: str | Column) -> Column:
    return F.size(pieces(text)).cast("long")


def replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


class Chain:
    """Literal replacements, one after the other. table: Arrow columns wrong and right, in the order of the chain.

    A text is asked once which of them it has, by hashes of its pieces of each length that occurs in the table; after a replacement only what
    stands around its places is asked again. So a text costs what it has, however long the chain is.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, table: pa.Table):
        self.wrong, self.right = (table[c].combine_chunks().cast(pa.large_string()) for c in ("wrong", "right"))
        self.powers = np.ones((2, 1), np.uint64)
        length = pc.utf8_length(self.wrong).to_numpy()
        self.longest, self.index = int(length.max(initial=0)), []
        for n in np.unique(length).tolist():
            rank = np.flatnonzero(length == n)
            codes = self._codes("".join(self.wrong.take(pa.array(rank)).to_pylist())).reshape(-1, n)
            hashes = np.zeros(len(rank), np.uint64)
            for k, power in enumerate(self._powers(n)[0]):
                hashes += codes[:, k] * power
            order = np.argsort(hashes, kind="stable")
            bits = 4 + int(len(rank)).bit_length()
            seen = np.zeros(1 << bits, bool)
            seen[self._mixed(hashes, bits)] = True
            self.index.append((n, bits, seen, hashes[order], rank[order]))

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)

    @staticmethod
    def _mixed(hashes: np.ndarray, bits: int) -> np.ndarray:
        return (hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)

    def _powers(self, n: int) -> np.ndarray:
        """Powers of the base and of its inverse, n of them at least."""
        if self.powers.shape[1] < n:
            steps = np.ones((2, 2 * n), np.uint64)
            steps[:, 1:] = np.array([[self.BASE], [pow(self.BASE, -1, 1 << 64)]], np.uint64)
            self.powers = np.cumprod(steps, axis=1, dtype=np.uint64)
        return self.powers[:, :n]

    def found(self, text: str, after: int = -1) -> set[int]:
        """Places in the chain, beyond `after`, of the replacements that the text has."""
        codes, out = self._codes(text), set()
        n = len(codes)
        power, inverse = self._powers(n)
        sums = np.append(np.uint64(0), np.cumsum(codes * power, dtype=np.uint64))
        for size, bits, seen, hashes, rank in self.index:
            if size > n:
                break
            own = (sums[size:] - sums[:-size]) * inverse[: n - size + 1]
            at = np.flatnonzero(seen[self._mixed(own, bits)])
            ends = np.searchsorted(hashes, own[at], "right").tolist()
            for k, a, b in zip(at.tolist(), np.searchsorted(hashes, own[at]).tolist(), ends, strict=True):
                out.update(r for r in rank[a:b].tolist() if r > after and self.wrong[r].as_py() == text[k : k + size])
        return out

    def applied(self, text: str) -> str:
        waiting = sorted(self.found(text))
        done = -1
        while waiting:
            rank = heappop(waiting)
            if rank == done:
                continue
            done, wrong, right = rank, self.wrong[rank].as_py(), self.right[rank].as_py()
            pieces = text.split(wrong)
            text, end = right.join(pieces), 0
            for piece in pieces[:-1]:
                end += len(piece)
                for r in self.found(text[max(0, end - self.longest + 1) : end + len(right) + self.longest - 1], rank):
                    heappush(waiting, r)
                end += len(right)
        return text


#: The chain that tasks of this process use.
_chain: dict[str, Chain] = {}


def replaced_by_table(text: Column, pairs: DataFrame) -> Column:
    """Literal replacements of a table (place, wrong, right), one after the other in the order of `place`: what one makes, a later one sees. Empty or null `wrong` changes nothing.

    Long chains are no expression that a plan could hold, so they run in an Arrow function, which looks only for what a text has. The table
    travels to the tasks whole, as Arrow's bytes.
    """
    table = pairs.where("wrong <> ''").select("place", F.col("wrong").cast("string").alias("wrong"), F.coalesce(F.col("right").cast("string"), F.lit("")).alias("right")).toArrow()
    table = table.sort_by([(c, "ascending") for c in ("place", "wrong", "right")]).select(["wrong", "right"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    sent, name = pairs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes()), uuid.uuid4().hex

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        if name not in _chain:
            _chain.clear()
            _chain[name] = Chain(pa.ipc.open_stream(sent.value).read_all())
        return texts.map(_chain[name].applied, na_action="ignore")

    return run(text)


def strip_controls(text: str | Column, c1: bool = False) -> Column:
    """Without control characters but tab and line breaks; c1: without U+0080-U+009F too."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F" + (r"\x{80}-\x{9f}" if c1 else "") + "]", "")


# Stand-ins for letters in old typesetting, and ligatures.
LIGATURES = [
    ("[dstrok]", "đ"), ("[Dstrok]", "Đ"), ("[tstrok]", "ŧ"), ("[Tstrok]", "Ŧ"), ("[scaron]", "š"), ("[Scaron]", "Š"), ("[zcaron]", "ž"), ("[Zcaron]", "Ž"),
    ("[ccaron]", "č"), ("[Ccaron]", "Č"), ("[eng", "ŋ"), (" ]", ""), ("Ď", "đ"), ("ď", "đ"),
    ("\x03", ""), ("\x04", ""), ("\x07", ""), ("\x08", ""), ("\x0f", ""), ("\x10", ""), ("\x11", ""), ("\x13", ""), ("\x14", ""), ("\x15", ""), ("\x17", ""), ("\x18", ""), ("\x1a", ""), ("\x1b", ""), ("\x1c", ""), ("\x1d", ""), ("\x1e", ""),
    ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "ft"),
]
# Control characters that stand for letters of another code page.
BAD_UNICODE = [("\x9a", "š"), ("\x8a", "Š"), ("\x9e", "ž"), ("\x8e", "Ž")]
# Characters that are written for others in one language.
LANGUAGE_FIXES = {
    "sms": [("’", "ʼ"), ("'", "ʼ"), ("′", "ʹ"), ("´", "ʹ"), ("́", "ʼ")],
    "mns": [
        ("", "А̄"), ("", "а̄"), ("", "Е̄"), ("", "е̄"), ("", "Ё̄"), ("", "ё̄"), ("", "О̄"), ("", "О̄"), ("", "о̄"),
        ("", "Ы̄"), ("", "ы̄"), ("", "Э̄"), ("", "э̄"), ("", "Ю̄"), ("", "ю̄"), ("", "Я̄"), ("", "я̄"),
    ],
}


def fix_ligatures(text: Column) -> Column:
    """Each stand-in with one following space first, then without."""
    return replace_all(text, [p for k, v in LIGATURES for p in ((k + " ", v), (k, v))])


def fix_bad_unicode(text: Column) -> Column:
    return F.translate(text, "".join(k for k, _ in BAD_UNICODE), "".join(v for _, v in BAD_UNICODE))


def fix_language(text: Column, lang: str | Column) -> Column:
    """Character repairs of the text's language; in Skolt Sami a modifier letter also takes no space before it."""
    code = F.col(lang) if isinstance(lang, str) else lang
    sms = F.regexp_replace(replace_all(text, LANGUAGE_FIXES["sms"]), WS + "+([ʼʹ])", "$1")
    return F.when(code == "sms", sms).when(code == "mns", replace_all(text, LANGUAGE_FIXES["mns"])).otherwise(text)


def soft_hyphens(text: Column, mark: str = "") -> Column:
    """Soft hyphens replaced by a mark; `xml` writes the element."""
    return F.replace(text, F.lit("­"), F.lit("<hyph/>" if mark == "xml" else mark))


# Letters that old prints write with a macron, and the ones meant.
CARONS = {"c": "č", "C": "Č", "s": "š", "S": "Š", "ʒ": "ǯ", "Ʒ": "Ǯ"}


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def carons(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends; letters with a combining macron as those with a caron."""
    return replace_all(F.array_join(pieces(text), " "), [(k + "\u0304", v) for k, v in CARONS.items()])


def colon_space(text: Column, words: list[str]) -> Column:
    """A space after `word:` where text follows at once, for the given words in any case."""
    return F.regexp_replace(text, "(?i)((?:" + "|".join(words) + r"):)(\S)", "$1 $2")


def crop_bytes(text: Column, most: int) -> Column:
    """The longest prefix of at most `most` UTF-8 bytes, in whole characters; meant for names, as it tries all prefixes."""
    fits = F.filter(F.sequence(F.lit(0), F.least(F.length(text), F.lit(most))), lambda k: F.octet_length(F.substring(text, F.lit(1), k)) <= most)
    return F.substring(text, F.lit(1), F.array_max(fits))


def human_size(n: Column) -> Column:
    """Bytes in binary units with one decimal."""
    out = F.format_string("%d B", n)
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.1f {unit}", n / F.lit(float(1024**k)))).otherwise(out)
    return out


# What text contains when one code page was read as another; the first test that holds decides.
_CYRILLIC = ("mhr", "mrj")


def _has(text: Column, *marks: str) -> Column:
    return reduce(lambda a, b: a & b, [F.contains(text, F.lit(m)) for m in marks])


def guess_encoding(text: Column, lang: Column) -> Column:
    """Name of the wrong decoding that a text shows, or null."""
    t, no = text, lambda m: ~F.contains(text, F.lit(m))
    cyrillic = lang.isin(*_CYRILLIC)
    rules = [
        (_has(t, "ì", "ò") & cyrillic, "cyrillic_in_pdf"),
        (_has(t, "à", "û") & cyrillic, "cp1251_cp1252"),
        ((_has(t, "‡") & no("ã")) | (_has(t, "Œ") & no("ÄŒ") & no("å")), "mac-sami_to_cp1252"),
        ((_has(t, "\x87") & no("ã")) | _has(t, "\x8c") | (_has(t, "¯") & no("á")), "mac-sami_to_latin1"),
        (_has(t, "\x87"), "mix-mac-sami-and-some-unknown-encoding"),
        (_has(t, "³", "¢", "¤"), "iso-ir-197_to_cp1252"),
        (_has(t, "á") & (_has(t, "ª") | _has(t, "∫")), "mac-sami_to_mac"),
        (_has(t, "ó", "ç", "ð"), "winsam_to_cp1252"),
        (_has(t, "á", "è", "ð"), "latin4_to_cp1252"),
        (_has(t, "ó", "ç", "¤"), "mix-of-latin4-and-iso-ir-197_to_cp1252"),
        (_has(t, "„") & (_has(t, "˜") | _has(t, "¹")), "winsami2_to_cp1252"),
        (_has(t, "þ", "š", "á"), "finnish-lawtexts-in-pdf"),
        (_has(t, "Ã¡"), "double-utf8"),
    ]
    out = F.when(*[rules[0][0], F.lit(rules[0][1])])
    for test, name in rules[1:]:
        out = out.when(test, F.lit(name))
    return out
