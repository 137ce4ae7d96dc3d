"""Models as pluggable stages: detectors and readers that run in Arrow batches, with deterministic stand-ins."""

from __future__ import annotations

import base64
import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.sources.documents import media_type

# Seconds and tokens that a call may take
PAGE_LIMITS, CROP_LIMITS, GROUNDED_LIMITS = (240.0, 6144), (60.0, 256), (240.0, 8192)
BLANK_DEVIATION = 12.0


class Detector(Protocol):
    def __call__(self, images: list[bytes]) -> list[list[tuple[float, float, float, float]]]:
        """Boxes of each image in pixels."""


Reader = Callable[[bytes], str]


def data_url(image: Column, kind: str = "image/jpeg") -> Column:
    # Spark breaks base64 into lines of 76 characters
    return F.concat(F.lit(f"data:{kind};base64,"), F.replace(F.base64(image), F.lit("\r\n"), F.lit("")))


@dataclass
class ChatReader:
    """A reader behind a chat completion endpoint; base and model come from the environment unless given."""

    prompt: str
    timeout: float = PAGE_LIMITS[0]
    tokens: int = PAGE_LIMITS[1]
    temperature: float = 0.1
    base: str = field(default_factory=lambda: os.environ.get("LLM_API_BASE", "http://localhost:1234/v1"))
    model: str = field(default_factory=lambda: os.environ.get("LLM_MODEL", ""))
    key: str = field(default_factory=lambda: os.environ.get("LLM_API_KEY", ""), repr=False)

    def __call__(self, image: bytes) -> str:
        url = f"data:{media_type(image)};base64," + base64.b64encode(image).decode()
        content = [{"type": "text", "text": self.prompt}, {"type": "image_url", "image_url": {"url": url}}]
        body = {"model": self.model, "temperature": self.temperature, "max_tokens": self.tokens, "messages": [{"role": "user", "content": content}]}
        request = urllib.request.Request(f"{self.base.rstrip('/')}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {}))
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.load(answer)["choices"][0]["message"]["content"] or ""
        except Exception as e:
            raise RuntimeError(f"no answer from {self.base} with model {self.model!r}: {e}") from e


@dataclass
class TaskReader:
    """A reader behind a service that takes a task and is asked for it until it is done. `call` sends a request."""

    call: Callable[[str, bytes | None], dict]
    every: float = 2.0
    timeout: float = 300.0
    sleep: Callable[[float], None] = time.sleep

    def __call__(self, content: bytes) -> str:
        task = self.call("submit", content)["data"]["task_id"]
        waited = 0.0
        while waited < self.timeout:
            self.sleep(self.every)
            waited += self.every
            answer = self.call(f"task/{task}", None)
            status = answer.get("data", {}).get("status")
            if status == "completed":
                return json.dumps(answer)
            if status in ("failed", "error"):
                raise RuntimeError(f"task {task} failed: {answer}")
        raise TimeoutError(f"task {task} took more than {self.timeout:g} s")


def detected(pages: DataFrame, detector: Detector, batch: int = 16) -> DataFrame:
    """(doc_id, page_index, box_idx, box): boxes of each page in 0..1, from the top, then from the left."""
    inside = "array<struct<x0:double,y0:double,x1:double,y1:double>>"

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in it:
            for i in range(0, rows.num_rows, batch):
                some = rows.slice(i, batch)
                found = detector(some.column(2).to_pylist())
                named = [[dict(zip(G.EDGES, map(float, b))) for b in boxes] for boxes in found]
                kind = pa.list_(pa.struct([(e, pa.float64()) for e in G.EDGES]))
                yield pa.RecordBatch.from_arrays([*(some.column(k) for k in (0, 1, 3, 4)), pa.array(named, kind)], ["doc_id", "page_index", "width", "height", "found"])

    found = pages.select("doc_id", "page_index", "image", "width", "height").mapInArrow(each, f"doc_id {pages.schema['doc_id'].dataType.simpleString()}, page_index int, width int, height int, found {inside}")
    unit = F.transform("found", lambda b: G.normalized(b, F.col("width"), F.col("height")))
    ranked = F.array_sort(F.transform(unit, lambda b, i: F.struct(b["y0"].alias("y"), b["x0"].alias("x"), i.alias("i"), b.alias("box"))))
    one = found.select("doc_id", "page_index", F.posexplode(ranked).alias("box_idx", "r"))
    return one.select("doc_id", "page_index", "box_idx", F.col("r.box").alias("box"))


def answers(images: DataFrame, reader: Reader, keys: list[str], concurrency: int = 1, keep_errors: bool = False) -> DataFrame:
    """(keys, raw, error): what the reader says of each image; a null image is read as an empty text.

    `concurrency` calls run at once in each task. Failures end the job, or fill `error` with `keep_errors`. Answers
    should be written before they are used twice: the stage is not deterministic.
    """
    fields = [images.schema[k] for k in keys]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), "raw string", "error string"])

    def one(image: bytes | None) -> tuple[str | None, str | None]:
        if image is None:
            return "", None
        try:
            return reader(image), None
        except Exception as e:
            if not keep_errors:
                raise
            return None, str(e)

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(max(1, concurrency)) as pool:
            for batch in it:
                said = list(pool.map(one, batch.column(len(keys)).to_pylist()))
                columns = [pa.array([s[i] for s in said], pa.string()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *columns], [*keys, "raw", "error"])

    return images.select(*keys, "image").mapInArrow(each, schema)


def crops(pages: DataFrame, boxes: DataFrame, skip_blank: bool = True) -> DataFrame:
    """(doc_id, page_index, box_idx, image): each box cut out of its page, enlarged if small; null where it is blank.

    A page is decoded once for all its boxes. Blank crops vary less than BLANK_DEVIATION in gray.
    """
    from quire.sources.documents import decoded, png, resized

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.binary()]
        for batch in it:
            for i, r in enumerate(batch.to_pylist()):
                gray = decoded(r["image"])
                out = []
                for b in r["rects"]:
                    cut = gray[b["y0"] : b["y1"], b["x0"] : b["x1"]]
                    blank = not cut.size or (skip_blank and float(cut.std()) < BLANK_DEVIATION)
                    out.append(None if blank else png(resized(cut, b["w"], b["h"])))
                columns = [[r["page_index"]] * len(out), [b["box_idx"] for b in r["rects"]], out]
                own = batch.column(0).take(pa.array([i] * len(out), pa.int64()))
                yield pa.RecordBatch.from_arrays([own, *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "page_index", "box_idx", "image"])

    sized = boxes.join(pages.select("doc_id", "page_index", "width", "height"), ["doc_id", "page_index"])
    rect = sized.select("doc_id", "page_index", "box_idx", G.crop_rect(F.col("box"), F.col("width"), F.col("height")).alias("c"))
    side = lambda a, b: F.greatest(F.lit(1), F.col(f"c.{b}") - F.col(f"c.{a}")).cast("double")
    rect = rect.withColumn("s", G.crop_size(side("x0", "x1"), side("y0", "y1")))
    rows = F.struct("box_idx", *(F.col(f"c.{e}").alias(e) for e in G.EDGES), F.col("s.w").alias("w"), F.col("s.h").alias("h"))
    listed = rect.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(rows)).alias("rects"))
    joined = pages.select("doc_id", "page_index", "image").join(listed, ["doc_id", "page_index"])
    return joined.mapInArrow(each, f"doc_id {pages.schema['doc_id'].dataType.simpleString()}, page_index int, box_idx int, image binary")
