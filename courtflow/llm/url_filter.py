"""URL filter by a bit-parallel wildcard automaton.

All glob rules are packed one after the other into one row of bits, 64 to a word: a start
bit for each rule and a bit for each of its literal places. Reading a character moves every
rule at once: shift the row by one place, keep the places whose character fits (Shift-And),
and keep places that stand before a wildcard. The batch of URLs of a task is simulated
together, one vector step a character, so the work is URLs x length x words and nothing is
shuffled.

Globs: ``?`` one character, ``*`` a run without ``/``, ``**`` any run. They match the whole
canonical URL, that is host (A-Z lower-cased) and path, without scheme, query and fragment.

Edge cases: null, empty or scheme-less URLs have empty host and path, no rule, and the
method's verdict; a rule without path fits every path; a URL may be of any length (batches
are cut by length); characters beyond ASCII equal no literal but fit wildcards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtflow.llm.common import query, table

#: (verdict, host, path) of the given rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Globs that block where no rule fits; all else is allowed.
BLOCK_GLOBS = ("**/login/**", "**/search/**", "**/cart/**", "**.exe", "**.zip")

OTHER = 128  # any character beyond ASCII


def glob_places(glob: str) -> list[str]:
    """The glob's elements: a character, '?', '*' or '**'."""
    out, i = [], 0
    while i < len(glob):
        step = 2 if glob.startswith("**", i) else 1
        out.append(glob[i : i + step])
        i += step
    return out


def literal(text: str) -> list[str]:
    """Elements that stand for themselves, whatever they are."""
    return ["\\" + c for c in text]


class Automaton:
    """Masks of all patterns; each pattern is a list of elements."""

    def __init__(self, patterns: Sequence[Sequence[str]]):
        start, final, fits, loops, bit = [], [], [], [], 0
        for elements in patterns:
            start.append(bit)
            for e in elements:
                if e in ("*", "**"):
                    loops.append((bit, e))
                else:
                    bit += 1
                    fits.append((bit, e))
            final.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))
        self.start, self.final = self._row(start), final
        self.fits = np.zeros((OTHER + 1, self.words), np.uint64)
        self.stays = np.zeros((OTHER + 1, self.words), np.uint64)
        for place, e in fits:
            row = self._row([place])
            if e == "?":
                self.fits |= row
            elif ord(e[-1]) < OTHER:
                self.fits[ord(e[-1])] |= row
        for place, e in loops:
            fitting = np.ones(OTHER + 1, bool)
            fitting[ord("/")] = e == "**"
            self.stays[fitting] |= self._row([place])

    def _row(self, bits: Sequence[int]) -> np.ndarray:
        row = np.zeros(self.words, np.uint64)
        for b in bits:
            row[b // 64] |= np.uint64(1) << np.uint64(b % 64)
        return row

    def matches(self, texts: Sequence[str], cells: int = 1 << 22) -> np.ndarray:
        """Boolean matrix: text x pattern."""
        out = np.zeros((len(texts), len(self.final)), bool)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        at = 0
        while at < len(order):
            width = max(1, len(texts[order[at]]))
            part = order[at : at + max(1, cells // width)]
            out[part] = self._simulate([texts[i] for i in part], width)
            at += len(part)
        return out

    def _simulate(self, texts: list[str], width: int) -> np.ndarray:
        codes = np.full((len(texts), width), OTHER, np.uint8)
        lengths = np.array([len(t) for t in texts])
        for i, t in enumerate(texts):
            raw = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            codes[i, : len(raw)] = np.minimum(raw, OTHER)
        state = np.tile(self.start, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        for k in range(width):
            n = int(np.searchsorted(-lengths, -k))  # texts are longest first: those that go on
            if n == 0:
                break
            s, c = state[:n], codes[:n, k]
            moved = s << one
            moved[:, 1:] |= s[:, :-1] >> top
            state[:n] = (moved & self.fits[c]) | (s & self.stays[c])
        final = np.array(self.final)
        return (state[:, final // 64] >> (final % 64).astype(np.uint64)) & one == one


def canonical(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host and path."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return df.withColumns({"host": F.translate(host, upper, lower), "path": path})


def judge(
    df: DataFrame,
    url: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    block: Sequence[str] = BLOCK_GLOBS,
) -> DataFrame:
    """Add host, path, rule and verdict; columns of these names are replaced. The longest
    rule that fits wins (ties: the first), else the verdict of the block globs."""
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    patterns = []
    for _, host, path in ranked:
        patterns += [[*literal(host + path), "**"], ["*", *literal("." + host + path), "**"]]
    automaton = Automaton(patterns + [glob_places(g) for g in block])
    n = len(ranked)
    names = np.array([h + p for _, h, p in ranked] + [None], object)
    verdicts = np.array([v for v, _, _ in ranked] + [""], object)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            hit = automaton.matches(urls.tolist())
            fits = hit[:, : 2 * n].reshape(-1, n, 2).any(axis=2)
            which = np.where(fits.any(axis=1), fits.argmax(axis=1) if n else 0, n)
            own = np.where(hit[:, 2 * n :].any(axis=1), "block", "allow")
            yield pd.DataFrame({"rule": names[which], "verdict": np.where(which < n, verdicts[which], own)})

    schema = T.StructType().add("rule", "string").add("verdict", "string")
    simulate = F.pandas_udf(run, schema)
    out = canonical(df, url).withColumn("__judged", simulate(F.concat("host", "path")))
    return out.withColumns({"rule": F.col("__judged.rule"), "verdict": F.col("__judged.verdict")}).drop("__judged")


SQL = r"""WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, '.' || host AS dotted FROM p),
f AS (SELECT page_id, host, path, CASE WHEN ends_with(dotted, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN ends_with(dotted, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN ends_with(dotted, '.net') AND starts_with(path, '/es/') THEN 'net/es/' WHEN ends_with(dotted, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN ends_with(dotted, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM r)
SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN contains(host || path, '/login/') OR contains(host || path, '/search/') OR contains(host || path, '/cart/') OR ends_with(host || path, '.exe') OR ends_with(host || path, '.zip')
  THEN 'block' ELSE 'allow' END AS verdict FROM f"""


@query("op6_url_filter", SQL)
def op6(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
