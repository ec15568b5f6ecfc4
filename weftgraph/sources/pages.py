"""JSON that comes in pages with links to the next page, from HTTP or from a folder.

    spark.dataSource.register(PagedJson)
    spark.read.format("pagedjson").option("starts", '["https://host/items?page=1"]').option("items", "data.items").load()

Each start begins a chain of pages and is one partition: a chain can only be followed in order, chains run side by side.
Options: `starts` (JSON array, or `path` for one), `items` and `next` (dotted paths to the array of items and to the link; a
page that is an array itself needs no items), `method`, `headers` and `params` (JSON objects), `paged` (follow links, true
unless said otherwise), `most` (pages of a chain, none unless given). A relative link counts from its page. A chain that comes
back to one of its pages raises an error, as does a page that can't be had after three tries.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlencode, urljoin, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weftgraph.sources.logs import Folder

TRIES, TIMEOUT = 3, 30
SCHEMA = "chain int, page int, place int, item string"


def fetch(url: str, method: str, headers: dict, params: dict):
    """One page."""
    if urlsplit(url).scheme not in ("http", "https"):
        folder, _, name = url.rpartition("/")
        page = Folder(folder).get(name)
        if page is None:
            raise FileNotFoundError(url)
        return page
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    body = json.dumps(params).encode() if method == "POST" else None
    if params and method != "POST":
        url += ("&" if urlsplit(url).query else "?") + urlencode(params)
    for n in range(TRIES):
        try:
            with urlopen(Request(url, body, headers, method=method), timeout=TIMEOUT) as answer:
                return json.loads(answer.read())
        except HTTPError as e:
            if n + 1 == TRIES or (e.code < 500 and e.code != 429):
                raise
        except OSError:
            if n + 1 == TRIES:
                raise
        time.sleep(2**n)


def at_path(page, path: str):
    """The value at a dotted path; None where there is none."""
    for part in filter(None, path.split(".")):
        page = page.get(part) if isinstance(page, dict) else None
    return page


@dataclass
class Chain(InputPartition):
    number: int
    start: str


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.starts = json.loads(options["starts"]) if "starts" in options else [options["path"]]
        self.items, self.next = options.get("items", ""), options.get("next", "next")
        self.method = options.get("method", "GET").upper()
        self.headers, self.params = (json.loads(options.get(k, "{}")) for k in ("headers", "params"))
        self.paged, self.most = options.get("paged", "true").lower() == "true", int(options.get("most", 0))

    def partitions(self) -> list[Chain]:
        return [Chain(k, s) for k, s in enumerate(self.starts)]

    def read(self, partition: Chain) -> Iterator[tuple]:
        url, seen, params = partition.start, set(), self.params
        while url:
            if url in seen:
                raise ValueError(f"the pages from {partition.start} lead back to {url}")
            page = fetch(url, self.method, self.headers, params)
            items = at_path(page, self.items)
            for k, item in enumerate(items if isinstance(items, list) else [] if items is None else [items]):
                yield partition.number, len(seen), k, json.dumps(item)
            seen.add(url)
            link = at_path(page, self.next) if self.paged and isinstance(page, dict) else None
            url = urljoin(url, link) if link and (not self.most or len(seen) < self.most) else None
            params = params if self.method == "POST" else {}  # a link has its parameters in it


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pagedjson"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def read_pages(spark: SparkSession, starts: list[str], schema: str | None = None, **options) -> DataFrame:
    """The items of all chains: as JSON with their places, or, with a schema, as its columns."""
    spark.dataSource.register(PagedJson)
    named = {k: v if isinstance(v, str) else json.dumps(v) for k, v in options.items()}
    df = spark.read.format("pagedjson").options(starts=json.dumps(starts), **named).load()
    return df.select(F.from_json("item", schema).alias("r")).select("r.*") if schema else df


def write_pages(df: DataFrame, folder: str, chain: str, order: list[str], size: int) -> DataFrame:
    """Rows as pages of JSON with links, a chain for each value of a column; (chain, pages). Rows are numbered within
    a chain, and a page is written by the task that has its rows."""
    from pyspark.sql import Window as W

    number = F.row_number().over(W.partitionBy(chain).orderBy(*order)) - 1
    total = F.count("*").over(W.partitionBy(chain))
    rows = df.select(F.col(chain).alias("chain"), F.to_json(F.struct("*")).alias("item"), number.alias("n"), F.ceil(total / size).cast("int").alias("pages"))
    pages = rows.groupBy("chain", (F.col("n") / size).cast("int").alias("page")).agg(F.first("pages").alias("pages"), F.sort_array(F.collect_list(F.struct("n", "item"))).alias("items"))

    def run(batches):
        target = Folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                following = f"{row['chain']}-{row['page'] + 1}.json" if row["page"] + 1 < row["pages"] else None
                items = [json.loads(i["item"]) for i in row["items"]]
                target.put(f"{row['chain']}-{row['page']}.json", {"data": {"items": items}, "links": {"next": following}})
            yield batch.select(["chain", "pages"])

    kind = df.schema[chain].dataType.simpleString()
    return pages.mapInArrow(run, f"chain {kind}, pages int").groupBy("chain").agg(F.max("pages").alias("pages"))
