"""URL filters: rules for hosts and paths, and logistic regression for the other urls.

``host``: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z
lower-cased. ``path``: what follows up to ``?``, ``#`` or the end. A null url, or one
without ``://``, has an empty host and an empty path.

A rule fits its host and all subdomains of it if the url's path starts with the rule's;
the longest rule that fits decides (rules of one length: the first in order). Other urls
are judged by a logistic regression on hashed character n-grams (3 to 5 characters) of
host and path, trained on a small table of labelled urls.

The table (``labelled_urls``, a parameter of ``judge``) is made of general words by subject,
some of which name unwanted pages, in host and path shapes as they are common for the one
kind, for the other, and for both. It was made
without a look at any table of pages. Subjects that are left out of it measure what the
model makes of words that it has not seen (tests and README).

Everything works row by row, urls are taken whole, however long; repeated rows and further
columns, whatever their names, change nothing, and an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 18
#: Rules: verdict, host, path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Words by subject, of hosts to block and of hosts to allow.
BLOCKED_WORDS = {
    "gambling": "poker roulette blackjack jackpot slots betting bookmaker wager bingo lottery lotto scratchcard",
    "medicine": "viagra cialis pharmacy painkillers steroids slimming tablets botox xanax tramadol ambien dieting",
    "sex": "porn xxx hentai escorts nude milf camgirls hookup erotic fetish stripchat swingers",
    "money": "payday loans forex bitcoin cryptoprofit cashback creditrepair debtrelief doubleyourmoney earnfast millionaire refinance",
    "advertising": "adserver popunder clickbank affiliate doubleclicks bannerfeed leadgen trafficboost seorank backlinks pixelsync retarget",
    "piracy": "warez keygen cracked serialz nulled torrentz modapk unlocker hackz cheats activator leaked",
    "fakes": "replica knockoff luxurywatches fakeid diplomas outletsale discountbags rolexcopy essaywriter followers likesboost giveaway",
}
ALLOWED_WORDS = {
    "science": "physics chemistry biology geology astronomy mathematics genetics ecology botany laboratory research theorem",
    "arts": "museum gallery poetry novels orchestra theatre sculpture painting ballet cinema photography architecture",
    "school": "university college library students lectures teachers homework grammar dictionary encyclopedia alumni campus",
    "news": "tribune gazette herald chronicle weather politics editorial reporters magazine journal broadcast bulletin",
    "public": "council ministry parliament hospital railway police firebrigade postoffice embassy harbour census heritage",
    "home": "gardening recipes cooking knitting carpentry bakery furniture parenting pets hiking cycling birdwatch",
    "software": "compiler database kernel opensource manual algorithms network protocol documentation developer editor terminal",
}
#: Shapes: ``{a}`` and ``{b}`` are words of one subject, ``{n}`` is a number.
BLOCKED_SHAPES = [
    "http://{a}-{b}{n}.xyz/go?aff={n}",
    "http://best-{a}-{b}.top/bonus/{n}",
    "https://{a}{b}{n}.click/landing.php?cid={n}&sub={b}",
    "http://www.{a}-{b}-online.info/promo/{n}",
    "https://{a}24-{b}.club/offer?ref={n}",
    "http://top-{a}.online/{b}-{a}-now.html",
    "https://buy-{a}-{b}.site/order?id={n}",
    "http://{a}-{b}.com/redirect?u={n}",
]
ALLOWED_SHAPES = [
    "https://www.{a}.com/{b}/{n}",
    "https://{a}.net/articles/{b}",
    "http://www.{a}{b}.edu/department/{b}/index.html",
    "https://{a}.gov.uk/guidance/{b}",
    "https://en.{a}.info/wiki/{b}",
    "http://{a}-{b}.de/about",
    "https://blog.{a}.io/posts/{n}/{b}",
    "https://{a}.ac.jp/docs/{b}.pdf",
]
#: Shapes that urls of both kinds have, so that words count beside shapes. Those to allow
#: have twice as many: unknown words in such a shape say nothing, and are allowed.
COMMON_SHAPES = [
    "https://{a}{b}.com/",
    "http://www.{a}{b}.net/en/{n}",
    "https://{a}.{b}.com/{n}.html",
    "http://m.{a}{b}.com/fr/{n}?page=2",
    "https://blog.{a}{b}.net/{n}#top",
    "http://{a}{b}.org/de/{n}/",
    "https://{a}.com/en/{n}.html?ref=x",
    "http://www.{b}{a}.info/{n}",
]


def labelled_urls(without: tuple[str, ...] = ()) -> list[tuple[str, int]]:
    """The small labelled table: url, and 1 for block or 0 for allow; ``without`` names
    subjects that are left out."""
    subjects = [(name, words.split(), 1) for name, words in BLOCKED_WORDS.items()]
    subjects += [(name, words.split(), 0) for name, words in ALLOWED_WORDS.items()]
    rows = []
    for name, words, label in subjects:
        if name not in without:
            rows += [(url, label) for url in _urls_of(words, label)]
    return rows


def _urls_of(words: list[str], label: int, common: bool = True) -> list[str]:
    shapes = list(BLOCKED_SHAPES if label else ALLOWED_SHAPES)
    if common:
        shapes += COMMON_SHAPES[::2] if label else COMMON_SHAPES
    made = []
    for k, word in enumerate(words):
        for j, shape in enumerate(shapes):
            made.append(shape.format(a=word, b=words[(k + j + 1) % len(words)], n=37 * (k * len(shapes) + j) % 9973))
    return made


def split_url(url: str) -> tuple[str, str]:
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    cut = min((at for at in map(rest.find, "?#") if at >= 0), default=len(rest))
    host, slash, path = rest[:cut].partition("/")
    return host.translate({c: c + 32 for c in range(65, 91)}), slash + path


def grams(host: str, path: str) -> np.ndarray:
    """Buckets of the distinct n-grams; those of host and path are kept apart."""
    found = set()
    for mark, part in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in (3, 4, 5):
            found.update(zlib.crc32((mark + part[i : i + n]).encode()) % DIMENSIONS for i in range(len(part) - n + 1))
    return np.array(sorted(found), np.int64)


def train(rows: list[tuple[str, int]], steps: int = 300, decay: float = 1e-3) -> np.ndarray:
    """Weights of the logistic regression, the intercept last."""
    features = [grams(*split_url(url)) for url, _ in rows]
    label = np.array([y for _, y in rows], np.float64)
    row = np.repeat(np.arange(len(rows)), [len(x) for x in features])
    column = np.concatenate(features)
    scale = 1 / np.sqrt(np.array([len(x) for x in features]))  # long urls weigh no more
    w = np.zeros(DIMENSIONS + 1)
    for _ in range(steps):
        total = np.bincount(row, weights=w[column], minlength=len(rows)) * scale + w[-1]
        error = 1 / (1 + np.exp(-total)) - label
        slope = np.bincount(column, weights=(error * scale)[row], minlength=DIMENSIONS) / len(rows)
        w[:-1] -= 20.0 * (slope + decay * w[:-1] / 10)
        w[-1] -= 2.0 * error.mean()
    return w


def score(w: np.ndarray, host: str, path: str) -> float:
    own = grams(host, path)
    return float(w[own].sum() / max(1, len(own)) ** 0.5 + w[-1])


def _scored(weights) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            parts = [split_url(url or "") for url in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    pa.array([host for host, _ in parts], pa.string()),
                    pa.array([path for _, path in parts], pa.string()),
                    pa.array([score(w, *part) for part in parts], pa.float64()),
                ],
                ["page_id", "host", "path", "score"],
            )

    return run


def rule_of(rules: list[tuple[str, str, str]], host: Column, path: Column, what: Callable) -> Column:
    """``what(rule)`` of the longest rule that fits, or null."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda rule: len(rule[1]) + len(rule[2])):
        own = ((host == rule[1]) | F.endswith(host, F.lit("." + rule[1]))) & F.startswith(path, F.lit(rule[2]))
        chosen = F.when(own, F.lit(what(rule))).otherwise(chosen)
    return chosen


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    labelled: list[tuple[str, int]] | None = None,
    threshold: float = 0.0,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row of ``pages``."""
    weights = pages.sparkSession.sparkContext.broadcast(train(labelled or labelled_urls()))
    page_id = pages.schema["page_id"].dataType.simpleString()
    scored = pages.select("page_id", "url").mapInArrow(
        _scored(weights), f"page_id {page_id}, host string, path string, score double"
    )
    host, path = F.col("host"), F.col("path")
    learnt = F.when(F.col("score") > threshold, "block").otherwise("allow")
    return scored.select(
        "page_id",
        "host",
        "path",
        rule_of(rules, host, path, lambda rule: rule[1] + rule[2]).alias("rule"),
        F.coalesce(rule_of(rules, host, path, lambda rule: rule[0]), learnt).alias("verdict"),
        "score",
    )
