"""URL filter: host and path rules first, else logistic regression on hashed character n-grams.

Host and path are cut out with built-in functions. A rule has a host and a path prefix; it fits the host and all
its subdomains, and the longest fitting rule decides. All other urls are judged by a logistic regression over the
hashed n-grams of host and path, trained from a small table of labelled urls.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import map_arrow, raw, row_chunks, source_columns

#: (verdict, host, path prefix)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

#: The labelled table that the regression learns from: urls of invented sites, wanted and unwanted.
WANTED = """
https://en.encyclopedia.example/wiki/Photosynthesis
https://www.university.example/physics/lecture-notes/chapter3.html
https://docs.language.example/3/library/functions.html
https://news.daily.example/2021/05/science/climate-report
https://blog.engineer.example/posts/consistent-hashing
https://journal.medicine.example/articles/cardiology-review
https://museum.art.example/collection/paintings/4411
https://library.city.example/catalogue/history
https://www.government.example/education/statistics
https://recipes.kitchen.example/bread/sourdough
https://forum.garden.example/t/tomato-seedlings/288
https://example.net/en/guide/installation
https://example.com/en/articles/astronomy
https://www.school.example/mathematics/geometry
https://travel.writers.example/stories/alps-by-train
https://m.weather.example/de/stadt/bericht
https://archive.letters.example/1890/poetry
https://tutorials.code.example/python/iterators
https://magazine.nature.example/fr/oiseaux-de-mer
https://www.radio.example/es/programas/historia
https://books.reader.example/novel/chapter-12
https://wiki.linux.example/index.php/Kernel
https://research.lab.example/papers/graph-theory
https://parliament.debates.example/minutes/2019
"""
UNWANTED = """
http://cheap-pills-online.example/buy-viagra-now
http://casino-bonus.example/free-spins?ref=88
http://xxx-videos.example/hot-girls/adult
http://win-big-casino.example/poker/jackpot
http://free-download-crack.example/keygen.exe
http://track.adserver.example/click?banner=331
http://best-replica-watches.example/discount-sale
http://login-verify-account.example/secure/update-password
http://payday-loans-fast.example/apply-now
http://adult-dating.example/live-cams/sexy
http://seo-backlinks.example/buy-links-cheap
http://torrent-movies.example/free-download/full-hd
http://slots-jackpot.example/online-betting/win
http://miracle-weight-loss.example/buy-now/pills
http://cheap-meds.example/no-prescription/order
http://porn-tube.example/adult/video/9931
http://earn-money-fast.example/work-from-home/bonus
http://click-track.example/redirect?offer=free-prize
http://bet-sports.example/odds/bonus-code
http://crypto-doubler.example/free-coins/invest-now
http://warez-keygen.example/serial/crack
http://cam-girls.example/xxx/private-show
http://fake-brand-outlet.example/replica/handbags-sale
http://prize-winner.example/claim-now/gift-card
"""

GRAMS = (3, 4, 5)
BITS = 15
STEPS, RATE, DECAY = 400, 2.0, 1e-3
_BASE = np.uint64(0x9E3779B97F4A7C15)


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last that fits, the longest, stands outermost
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of `^host` and `^path$`, in one row after the other, and the offsets of the rows."""
    (h, h_at), (p, p_at) = raw(hosts), raw(paths)
    n = np.diff(h_at) + np.diff(p_at) + 3
    at = np.concatenate([[0], np.cumsum(n)])
    text = np.full(at[-1], 94, np.uint8)
    for data, src, shift in ((h, h_at, 1), (p, p_at, 2)):
        sizes = np.diff(src)
        before = at[:-1] + shift + (np.diff(h_at) if shift == 2 else 0)
        text[np.repeat(before - src[:-1], sizes) + np.arange(src[-1])] = data
    text[at[1:] - 1] = 36
    part = np.zeros(at[-1], np.uint64)  # host and path have their own grams
    path_start = at[:-1] + 1 + np.diff(h_at)
    row = np.repeat(np.arange(len(n)), n)
    part[np.arange(at[-1]) >= path_start[row]] = 1
    out, rows = [], []
    for g in GRAMS:
        size = max(0, len(text) - g + 1)
        value = part[:size] * np.uint64(77) + np.uint64(g)
        for t in range(g):
            value = value * _BASE + text[t : t + size].astype(np.uint64) + np.uint64(1)
        value ^= value >> np.uint64(33)
        inside = (row[:size] == row[g - 1 :]) & (part[:size] == part[g - 1 :])
        out.append(((value * _BASE) >> np.uint64(64 - BITS)).astype(np.int64)[inside])
        rows.append(row[:size][inside])
    rows, out = np.concatenate(rows), np.concatenate(out)
    order = np.argsort(rows, kind="stable")
    return out[order], np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(n)))]).astype(np.int64)


def split_url(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2].split("?")[0].split("#")[0]
    host, slash, path = rest.partition("/")
    return host.lower(), slash + path


def train(wanted: list[str], unwanted: list[str]) -> np.ndarray:
    """Weights and, last, the bias of the regression: full-batch gradient descent, the same every time."""
    parts = [split_url(u) for u in [*wanted, *unwanted]]
    cells, at = features(pa.array([h for h, _ in parts]), pa.array([p for _, p in parts]))
    n = np.diff(at)
    row, scale = np.repeat(np.arange(len(parts)), n), np.repeat(1 / np.sqrt(np.maximum(n, 1)), n)
    y = np.array([0.0] * len(wanted) + [1.0] * len(unwanted))
    w, bias = np.zeros(1 << BITS), 0.0
    for _ in range(STEPS):
        z = np.bincount(row, w[cells] * scale, len(parts)) + bias
        error = (1 / (1 + np.exp(-z)) - y) / len(parts)
        w -= RATE * (np.bincount(cells, error[row] * scale, len(w)) + DECAY * w)
        bias -= RATE * error.sum()
    return np.append(w, bias)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES, wanted: str = WANTED, unwanted: str = UNWANTED) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every url.

    score is the probability of being unwanted by the regression; from 0.5 on its verdict is block. The longest
    fitting rule overrides it. A url that is null or has no :// has an empty host and path, fits no rule, and is
    judged by the bias and the empty grams alone. Repeated rows and null ids stay; other columns are not read.
    """
    weights = train(wanted.split(), unwanted.split())
    model = pages.sparkSession.sparkContext.broadcast(weights)
    slim = source_columns(pages, page_id=id_col, url=url_col)
    slim = slim.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    slim = slim.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"))

    def run(batches):
        w = model.value
        for batch in batches:
            hosts, paths = batch.column(1), batch.column(2)
            _, at = raw(pc.binary_join_element_wise(hosts, paths, ""))
            score = np.zeros(len(hosts))
            for a, b in row_chunks(at):
                cells, rows_at = features(hosts[a:b], paths[a:b])
                n = np.diff(rows_at)
                sums = np.bincount(np.repeat(np.arange(b - a), n), w[cells], b - a)
                score[a:b] = 1 / (1 + np.exp(-(sums / np.sqrt(np.maximum(n, 1)) + w[-1])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=["page_id", "host", "path", "rule", "said", "score"])

    out = map_arrow(slim, run, f"page_id {dict(slim.dtypes)['page_id']}, host string, path string, rule string, said string, score double")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
