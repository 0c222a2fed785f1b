"""URL filtering: written rules first, then rules mined by association.

Written rules are an action and a host with a path (``net/es/``): a rule fits
its host and all subdomains if the url's path starts with the rule's; the
longest wins.

Other urls get the method's verdict. A url is a set of tokens: its scheme and
domain, all labels and words of the host, all path segments, the words of the
file name, all names of query parameters, and whether it has a fragment. Tokens
that are not frequent among bad urls cannot be part of a rule and are left out
before mining. Spark's FP-growth finds the frequent token combinations among
labelled urls; combinations that go with ``block`` with enough support,
confidence and odds become rules. Where enough urls to be frequent have over
``LONG`` such tokens each (2^LONG combinations could be frequent at once), the
same patterns are grown depth first, without a bound of their length: a token
that all urls of a pattern have is not added to it, as it would make the same
urls another time, and a pattern that only bad urls have is not grown, as all
rules from it are as sure with no more support. So each rule left out has a
shorter one of the same or greater confidence and support that fits wherever it
fits: verdicts and confidences are those of all rules. Time is exponential in
the number of tokens that are frequent together, none of them implied by others.
An inverted index from each
rule's rarest token finds the rules whose tokens a url has all of; the most
confident one blocks it, and without one it is allowed.

Mined rules go to the workers in blocks of at most ``BLOCK_RULES``, one pass
each, so their number is not limited.

Defined cases: a null url, or one without ``://``, has an empty host and path,
no written rule and no token; without labels, nothing is mined; labels that
repeat an id count once, as bad if any of them is; repeated pages are judged
each; labels without a page, or with null values, are not learned from; an empty
table of pages gives no rows; urls of any length are judged whole; of equally
confident rules the one with more support names the match, then the smaller name
(of the rules kept).
All columns of pages are kept; those named like an added one are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from math import ceil, comb

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import groups_of, pieces, written

ALLOW, BLOCK = "allow", "block"
#: Thresholds: share and number of labelled urls, confidence, and odds of bad over those of all labelled urls
#: (reached at any share of bad urls; wherever confidence over that share is as high, the odds are too).
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE, MIN_LIFT = 0.001, 20, 0.6, 1.5
BLOCK_RULES = 50_000
#: Tokens up to which all frequent combinations are mined; beyond, those that no shorter one replaces. Tokens of a batch.
LONG, DEALT = 16, 1_000_000
#: For ``rule_length``: combinations of a url on average, and of any one url.
COMBINATIONS, MOST_COMBINATIONS = 1 << 10, 1 << 20
_LABEL = {ALLOW: "label=allow", BLOCK: "label=block"}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = re.split("[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.encode("utf-8", "replace").lower().decode(), slash + path


def tokens_of(url: str | None) -> list[str]:
    """The distinct tokens of a url, in order of its places."""
    if url is None or "://" not in url:
        return []
    scheme, rest = url.split("://", 1)
    host, path = split_url(url)
    labels = [x for x in host.split(":")[0].split(".") if x]
    words = [w for w in re.split("[-_]+", labels[-2] if len(labels) > 1 else host) if w]
    steps = [x for x in path.split("/") if x]
    before, fragment, _ = rest.partition("#")
    _, asked, query = before.partition("?")
    found = [f"scheme={scheme.lower()}"]
    if labels:
        found += [f"top={labels[-1]}", f"domain={'.'.join(labels[-2:])}"]
    if len(labels) > 2:
        found += [f"site={labels[-3]}", f"sub={labels[0]}"]
        found += [f"label={x}" for x in labels[1:-3]]
        found += [f"siteword={w}" for x in labels[:-2] for w in re.split("[-_]+", x) if w]
    found += [f"word={w}" for w in words]
    if steps:
        name, dot, ext = steps[-1].rpartition(".")
        found += [f"dir={steps[0]}", f"ext={ext if dot else ''}"]
        found += [f"step={x}" for x in steps[1:]]
        found += [f"fileword={w}" for w in re.split(r"[\W_]+", name if dot else ext) if w]
    if asked:
        found += [f"query={x.partition('=')[0]}" for x in query.split("&")]
    if fragment:
        found.append("fragment=True")
    return list(dict.fromkeys(found))


class WrittenRules:
    """(action, pattern) pairs, by host."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for action, pattern in rules:
            host, slash, path = pattern.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, action, pattern))

    def judge(self, host: str, path: str) -> tuple[str, str] | None:
        """(pattern, action) of the longest rule that fits."""
        best = None
        at = host
        while at:
            for start, action, pattern in self.by_host.get(at, ()):
                if path.startswith(start) and (best is None or len(pattern) > len(best[0])):
                    best = pattern, action
            at = at.partition(".")[2]
        return best


class MinedRules:
    """Token combinations that block, with an index from each one's rarest token."""

    def __init__(self, rules: list[tuple[list[str], float, float]]) -> None:
        uses = Counter(t for tokens, _, _ in rules for t in tokens)
        self.index: dict[str, list[tuple[float, float, str, frozenset[str]]]] = {}
        for tokens, confidence, support in rules:
            rarest = min(tokens, key=lambda t: (uses[t], t))
            self.index.setdefault(rarest, []).append((confidence, support, " ".join(sorted(tokens)), frozenset(tokens)))

    def match(self, tokens: list[str]) -> tuple[float, str] | None:
        """Confidence and name of the best rule whose tokens are all there."""
        own = set(tokens)
        fits = [r[:3] for t in own for r in self.index.get(t, ()) if r[3] <= own]
        if not fits:
            return None
        confidence, _, name = min(fits, key=lambda r: (-r[0], -r[1], r[2]))
        return confidence, name


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        rows = zip(batch.column("url").to_pylist(), batch.column("bad").to_pylist(), strict=True)
        items = [[*tokens, _LABEL[BLOCK if bad else ALLOW]] for url, bad in rows if (tokens := tokens_of(url))]
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.list_(pa.string()))], names=["items"])


def labelled_tokens(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Token sets of labelled pages, each with its label as one more item."""
    bad = F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).alias("bad")
    judged = labels.where("doc_id is not null and (toxic is not null or quality is not null)").groupBy(F.col("doc_id").alias("page_id")).agg(bad)
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).join(judged, "page_id")
    return rows.select("url", "bad").mapInArrow(_labelled, "items array<string>")


def _only(kept: frozenset[str]):
    """Items without those that are not frequent."""

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            items = [[x for x in row if x in kept] for row in batch.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.list_(pa.string()))], names=["items"])

    return only


def rule_length(sizes: dict[int, int]) -> int:
    """Most tokens of a rule whose combinations could all be counted within the bounds; ``sizes`` are numbers
    of urls by number of tokens. ``mine`` is not bounded by it."""
    room, length = COMBINATIONS * sum(sizes.values()), 1
    while length < max(sizes):
        made = {n: sum(comb(n, k) for k in range(1, length + 2)) for n in sizes}
        if max(made.values()) > MOST_COMBINATIONS or sum(made[n] * urls for n, urls in sizes.items()) > room:
            break
        length += 1
    return length


def _dealt(rank: dict[str, int]):
    """(tokens, n, bad) to each token with those of a higher rank beside it."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("token", pa.int32()), ("rest", pa.list_(pa.int32())), ("n", pa.int64()), ("bad", pa.int64())])
        for batch in pieces(batches):
            rows, held = [], 0
            for row in batch.to_pylist():
                own = sorted(rank[x] for x in row["tokens"])
                for i, x in enumerate(own):
                    rows.append({"token": x, "rest": own[i + 1 :], "n": row["n"], "bad": row["bad"]})
                    held += len(own) - i
                    if held >= DEALT:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return dealt


def grown(prefix: tuple[int, ...], rows: dict[tuple[int, ...], tuple[int, int]], least: int) -> Iterator[tuple[tuple[int, ...], int, int]]:
    """Patterns from ``prefix`` on with numbers of urls and of bad ones, from its urls' further
    tokens: all but those with a shorter one of the same urls, or grown from one of bad urls only."""
    n, bad = (sum(x) for x in zip(*rows.values(), strict=True))
    yield prefix, n, bad
    if bad == n:
        return
    all_of, bad_of = Counter(), Counter()
    for tokens, (k, b) in rows.items():
        for x in tokens:
            all_of[x] += k
            bad_of[x] += b
    for x in sorted(x for x, b in bad_of.items() if b >= least and all_of[x] < n):
        some: dict[tuple[int, ...], tuple[int, int]] = {}
        for tokens, (k, b) in rows.items():
            if x in tokens:
                rest = tuple(y for y in tokens if y > x and bad_of[y] >= least and all_of[y] < n)
                before = some.get(rest, (0, 0))
                some[rest] = before[0] + k, before[1] + b
        yield from grown((*prefix, x), some, least)


def _grown(names: list[str], least: int):
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("antecedent", pa.list_(pa.string())), ("bad", pa.int64()), ("n", pa.int64())])

        def patterns() -> Iterator[dict]:
            for table in groups_of(batches, ["token"]):
                by_token: dict[int, dict] = {}
                for row in table.to_pylist():
                    own, rest = by_token.setdefault(row["token"], {}), tuple(row["rest"])
                    before = own.get(rest, (0, 0))
                    own[rest] = before[0] + row["n"], before[1] + row["bad"]
                for token, rows in by_token.items():
                    for found, n, bad in grown((token,), rows, least):
                        yield {"antecedent": sorted(names[x] for x in found), "bad": bad, "n": n}

        rows = patterns()
        while part := list(islice(rows, 10_000)):
            yield pa.RecordBatch.from_pylist(part, schema)

    return grow


def mine(items: DataFrame) -> DataFrame:
    """Rules to block: antecedent, confidence, support (of tokens and label together)."""
    spark = items.sparkSession
    items = written(items, "items")
    total = items.count()
    bad = items.where(F.array_contains("items", _LABEL[BLOCK]))
    support = max(MIN_SUPPORT, min(1.0, MIN_COUNT / total)) if total else 1.0
    least = ceil(support * total)
    # at most 1 / MIN_SUPPORT times the tokens of a mean url
    often = bad.select(F.explode("items").alias("item")).groupBy("item").count().where(F.col("count") >= least)
    often = {r["item"]: r["count"] for r in often.collect()}
    if _LABEL[BLOCK] not in often:
        return spark.createDataFrame([], "antecedent array<string>, confidence double, support double")
    share = often[_LABEL[BLOCK]] / total
    items = written(items.mapInArrow(_only(frozenset(often)), "items array<string>"), "items")
    sizes = items.select(F.size(F.array_remove("items", _LABEL[BLOCK])).alias("n")).groupBy("n").count().collect()
    sizes = {r["n"]: r["count"] for r in sizes}
    label = F.array_contains("items", _LABEL[BLOCK])
    # suffix trees are dealt by item; as many parts as any other exchange has
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if sum(urls for n, urls in sizes.items() if n > LONG) < least:
        sets = FPGrowth(itemsCol="items", minSupport=support, minConfidence=MIN_CONFIDENCE, numPartitions=parts).fit(items).freqItemsets
        tokens = F.array_sort(F.array_remove("items", _LABEL[BLOCK])).alias("antecedent")
        counts = sets.groupBy(tokens).agg(F.sum(F.when(label, F.col("freq"))).alias("bad"), F.sum(F.when(~label, F.col("freq"))).alias("n"))
    else:
        # rare tokens first: their urls are few, and what many urls have is beside them
        names = sorted(often.keys() - {_LABEL[BLOCK]}, key=lambda x: (often[x], x))
        tokens = F.array_sort(F.array_remove("items", _LABEL[BLOCK])).alias("tokens")
        sets = items.groupBy(tokens).agg(F.count("*").alias("n"), F.count_if(label).alias("bad"))
        dealt = sets.mapInArrow(_dealt({x: i for i, x in enumerate(names)}), "token int, rest array<int>, n long, bad long")
        dealt = dealt.repartition(parts, "token").sortWithinPartitions("token")
        counts = dealt.mapInArrow(_grown(names, least), "antecedent array<string>, bad long, n long")
    rules = counts.where((F.size("antecedent") > 0) & (F.col("bad") >= least)).withColumn("confidence", F.col("bad") / F.col("n"))
    odds = F.col("confidence") * (1 - share) >= MIN_LIFT * share * (1 - F.col("confidence"))
    rules = rules.where((F.col("confidence") >= MIN_CONFIDENCE) & odds)
    return rules.select("antecedent", "confidence", (F.col("bad") / total).alias("support"))


def rule_blocks(rules: DataFrame) -> Iterator[MinedRules]:
    blocks = -(-rules.count() // BLOCK_RULES)
    for block in range(blocks):
        rows = rules.where(F.pmod(F.xxhash64("antecedent"), F.lit(blocks)) == block)
        yield MinedRules([(r["antecedent"], r["confidence"], r["support"]) for r in rows.toLocalIterator()])


HOST, PATH, RULE, VERDICT, MINED, CONFIDENCE = (f"urlrules__{x}" for x in ("host", "path", "rule", "verdict", "mined", "confidence"))


def _judge(written: WrittenRules, mined: MinedRules):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            added: dict[str, list] = {x: [] for x in (HOST, PATH, RULE, VERDICT, MINED, CONFIDENCE)}
            before = zip(batch.column("url").to_pylist(), batch.column(MINED).to_pylist(), batch.column(CONFIDENCE).to_pylist(), strict=True)
            for url, name, confidence in before:
                host, path = split_url(url)
                rule = written.judge(host, path)
                found = mined.match(tokens_of(url))
                if found and (confidence is None or (-found[0], found[1]) < (-confidence, name)):
                    confidence, name = found
                verdict = rule[1] if rule else BLOCK if name is not None else ALLOW
                for key, value in zip(added, (host, path, rule[0] if rule else None, verdict, name, confidence), strict=True):
                    added[key].append(value)
            columns = [
                pa.array(added[n], pa.float64() if n == CONFIDENCE else pa.string()) if n in added else batch.column(n) for n in batch.schema.names
            ]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return judge


def judge_pages(pages: DataFrame, written: list[tuple[str, str]], rules: DataFrame) -> DataFrame:
    """All rows and columns of ``pages`` (with a string ``url``), and HOST, PATH, RULE (the
    written one, or null), VERDICT, MINED and CONFIDENCE (of the best mined rule, or null)."""
    found = pages.withColumns(
        {x: F.lit(None).cast("double" if x == CONFIDENCE else "string") for x in (HOST, PATH, RULE, VERDICT, MINED, CONFIDENCE)}
    )
    done = False
    for mined in rule_blocks(rules):
        found, done = found.mapInArrow(_judge(WrittenRules(written), mined), found.schema), True
    return found if done else found.mapInArrow(_judge(WrittenRules(written), MinedRules([])), found.schema)
