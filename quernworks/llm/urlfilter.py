"""URL filters: a bit-parallel automaton that runs many glob rules over each canonical URL at once.

A rule is a sequence of items, each a literal character or a wildcard. All rules lie end to end in a
row of bits, in as many 64-bit words as they need. In Shift-And, bit j says that the text so far ends
a match of the rule's first j+1 items; reading character c turns state D into
((D << 1) | first) & B[c] | D & S[c], where B[c] has the items that c fits and S[c] the wildcards
that c may prolong. The batch is stepped in lock step: one numpy operation moves all URLs of a batch.

The canonical URL is ".", host, a separator that no text holds, then the path. `*` in a rule's host
part therefore cannot reach into the path.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: The symbol between host and path; code points end at 0x10FFFF.
SEPARATOR = 0x110000
#: Characters of URLs stepped at once; longer batches are split.
_STEP_CELLS = 4 << 20


@dataclass(frozen=True)
class Rule:
    """host and path prefix; the rule fits the host, all its subdomains, and paths that begin so."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def items(self) -> list[int | str]:
        """Any labels, a dot, the host, the separator, the path, anything. `*` in host or path is a wildcard."""
        part = lambda s: ["*" if c == "*" else ord(c) for c in s]
        return ["*", ord("."), *part(self.host), SEPARATOR, *part(self.path), "**"]


class GlobAutomaton:
    """Masks of all rules. ``*`` spans any characters but the separator, ``**`` any at all; both may be empty."""

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.rules = list(rules)
        bits: list[tuple[int | str, bool]] = []  # (item, whether a rule begins here)
        self.final: list[int] = []
        for rule in self.rules:
            items = rule.items()
            for i, item in enumerate(items):
                bits.append((item, i == 0))
            self.final.append(len(bits) - 1)
        self.words = max(1, -(-len(bits) // 64))
        self.bits = bits
        literal = sorted({b for b, _ in bits if isinstance(b, int)})
        self.alphabet = np.array(literal, np.int64)
        self.begin = self._mask(j for j, (_, head) in enumerate(bits) if head)
        # one column for each literal symbol, and one for all the rest
        self.fits = np.array([self._mask(j for j, (b, _) in enumerate(bits) if b == c or b == "**" or b == "*" and c != SEPARATOR) for c in [*literal, -1]])
        self.stays = np.array([self._mask(j for j, (b, _) in enumerate(bits) if b == "**" or b == "*" and c != SEPARATOR) for c in [*literal, -1]])
        self.empty = self._mask(j for j, (b, _) in enumerate(bits) if isinstance(b, str))

    def _mask(self, at: Iterable[int]) -> np.ndarray:
        out = [0] * self.words
        for j in at:
            out[j // 64] |= 1 << (j % 64)
        return np.array(out, np.uint64)

    def _skip(self, state: np.ndarray, begun: np.ndarray) -> np.ndarray:
        """Wildcards may match nothing: a state right before one also stands on it. No rule has two in a row but at most a few."""
        while True:
            more = state | ((self._shift(state) | begun) & self.empty)
            if (more == state).all():
                return state
            state = more

    def _shift(self, state: np.ndarray) -> np.ndarray:
        out = state << np.uint64(1)
        if self.words > 1:
            out[:, 1:] |= state[:, :-1] >> np.uint64(63)
        return out & ~self.begin  # no rule runs on into the next

    def states(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The masks (rows x words) after the whole of each row of symbols."""
        known = np.searchsorted(self.alphabet, symbols)
        known[known == len(self.alphabet)] = 0
        index = np.where(self.alphabet[known] == symbols, known, len(self.alphabet)) if len(self.alphabet) else np.zeros_like(symbols)
        n = len(lengths)
        state = self._skip(np.zeros((n, self.words), np.uint64), self.begin)
        out = state.copy()
        none = np.zeros(self.words, np.uint64)
        for i in range(symbols.shape[1]):
            live = lengths > i
            begun = self.begin if i == 0 else none
            column = index[:, i]
            step = (self._shift(state) | begun) & self.fits[column] | state & self.stays[column]
            state = self._skip(step, none)
            out[live] = state[live]
        return out

    def fitting(self, states: np.ndarray, rule: int) -> np.ndarray:
        """Whether a rule fits, by its last bit."""
        word, bit = divmod(self.final[rule], 64)
        return (states[:, word] >> np.uint64(bit)) & np.uint64(1) == 1


def canonical_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path of ``url``; both are empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^([^/]*)", 1), upper, lower)
    return df.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1))


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns of ``keep`` with host, path, rule and verdict of each row.

    The longest fitting rule (host and path, in characters) decides; of equally long ones that with the
    longer host, then the earlier. No rule: null and ``default``. Null or malformed urls have an empty
    host, which no rule fits. Repeated rows are judged alike; nothing is shuffled. The masks, as long
    as the rule list, go to the executors with the function.
    """
    automaton = GlobAutomaton(rules)
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].text), -len(rules[i].host), i))
    texts = np.array([rules[i].text for i in order] + [None], object)
    verdicts = np.array([rules[i].verdict for i in order] + [default], object)
    parts = canonical_parts(pages.select(*keep, F.col(url).alias("url")), "url").select(*keep, "host", "path")
    schema = StructType([*parts.schema.fields, StructField("rule", StringType()), StructField("verdict", StringType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            codes = np.frombuffer("".join(f".{h}/{p}" for h, p in zip(hosts, paths, strict=True)).encode("utf-32-le"), np.uint32).astype(np.int64)
            n_host = np.fromiter(map(len, hosts), np.int64, len(hosts))
            lengths = n_host + np.fromiter(map(len, paths), np.int64, len(paths)) + 2
            starts = np.cumsum(lengths) - lengths
            codes[starts + n_host + 1] = SEPARATOR
            by_length = np.argsort(lengths, kind="stable")
            first = np.full(len(lengths), len(order))
            lo = 0
            while lo < len(lengths):
                hi = lo + 1
                while hi < len(lengths) and (hi - lo + 1) * lengths[by_length[hi]] <= _STEP_CELLS:
                    hi += 1
                some = by_length[lo:hi]
                symbols = np.full((len(some), int(lengths[some[-1]])), -2, np.int64)
                for k, i in enumerate(some):
                    symbols[k, : lengths[i]] = codes[starts[i] : starts[i] + lengths[i]]
                states = automaton.states(symbols, lengths[some])
                for rank in reversed(range(len(order))):
                    first[some[automaton.fitting(states, order[rank])]] = rank
                lo = hi
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts[first], pa.string()), pa.array(verdicts[first], pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    return parts.mapInArrow(judge, schema)


#: The rules of the registered query.
RULES = [
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
]


SQL = r"""
with u as (
  select page_id, case when url is not null and strpos(url, '://') > 0
    then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') else '' end as rest
  from pages),
p as (
  select page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) as path from u),
r(rhost, rpath, rverdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m as (
  select p.page_id, p.host, p.path, max_by(rhost || rpath, length(rhost || rpath)) as rule,
         max_by(rverdict, length(rhost || rpath)) as verdict
  from p left join r on (p.host = rhost or ends_with(p.host, '.' || rhost)) and starts_with(p.path, rpath)
  group by p.page_id, p.host, p.path)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from m
"""
