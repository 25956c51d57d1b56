"""Downloads by tasks, with a limit for each host.

Addresses are dealt out by host and slot: a host has `per_host` slots, all addresses of a slot are in one task, and a task
asks one after the other, `interval` seconds apart at least. So a host never sees more than per_host requests at a time, however
many tasks run, and hosts don't wait for each other.

A file is written under a name of its own and renamed once it is whole; one that is there already is left alone. A task that
runs again, or twice at once, therefore costs at most its unfinished file, and nobody sees half a file.

Files are written by the tasks through pyarrow's file systems, so the folder must be an address that these know.

Defined cases: a null address is left out; one that stands several times is fetched once; of addresses with the same last name
the first in order is fetched and the others are failures that say so; one that can't be had after `attempts` is a row with
its error, not an error of the job; no addresses give no rows.
"""

from __future__ import annotations

import time
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PER_HOST, ATTEMPTS, READ_BYTES = 2, 3, 1 << 20
RESULT = "url string, path string, bytes long, fetched boolean, error string"


def fetch_one(url: str, folder: str, opened: Callable = urllib.request.urlopen, attempts: int = ATTEMPTS, wait: float = 1.0) -> tuple[str, int, bool]:
    """The path of the file that a url names, its size, and whether it was fetched now; waits longer after each failure."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(folder)
    to = f"{at.rstrip('/')}/{url.rsplit('/', 1)[-1]}"
    for i in range(1, attempts + 1):
        if (info := store.get_file_info(to)).type == fs.FileType.File:
            return to, info.size, False
        part = f"{to}.{uuid.uuid4().hex}.part"
        try:
            size = 0
            with opened(url) as got, store.open_output_stream(part) as out:
                while data := got.read(READ_BYTES):
                    out.write(data)
                    size += len(data)
                said = got.headers.get("Content-Length") if hasattr(got, "headers") else None
            if said is not None and int(said) != size:
                raise OSError(f"{size} bytes of {said} came")
            store.move(part, to)
            return to, size, True
        except OSError:
            if store.get_file_info(part).type == fs.FileType.File:
                store.delete_file(part)
            if i == attempts:
                raise
            time.sleep(wait * 2**i)
    raise ValueError("attempts must be positive")


def fetched(
    urls: DataFrame, folder: str, per_host: int = PER_HOST, interval: float = 0.0, opened: Callable = urllib.request.urlopen,
    attempts: int = ATTEMPTS, wait: float = 1.0,
) -> DataFrame:
    """url, path, bytes, fetched (now, not before) and error of each of urls (url). Nothing is fetched until it is read, and
    reading it again fetches what is missing only."""
    name = F.element_at(F.split("url", "/"), -1)
    rows = urls.where("url is not null").select("url").distinct().withColumn("name", name)
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("url")))
    host = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))
    rows = rows.withColumns({"host": host, "slot": F.pmod(F.xxhash64("url"), F.lit(per_host))})

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for b in batches:
            for url, nth, its_host in zip(b["url"], b["nth"], b["host"]):
                row = {"url": url, "path": None, "bytes": None, "fetched": False, "error": None}
                if nth > 1:
                    row["error"] = "another address has a file of this name"
                else:
                    if (ahead := last.get(its_host, float("-inf")) + interval - time.monotonic()) > 0:
                        time.sleep(ahead)
                    last[its_host] = time.monotonic()
                    try:
                        row["path"], row["bytes"], row["fetched"] = fetch_one(url, folder, opened, attempts, wait)
                    except (OSError, ValueError) as e:
                        row["error"] = str(e)
                yield pd.DataFrame([row]).astype({"bytes": "Int64", "path": object, "error": object})

    dealt = rows.repartition("host", "slot").sortWithinPartitions("host", "slot", "url").select("url", "nth", "host")
    return dealt.mapInPandas(fetch, RESULT)
