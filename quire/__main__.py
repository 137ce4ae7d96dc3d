"""Command line: one input file or folder to searchable files."""

from __future__ import annotations

import importlib
import importlib.util
import logging
import os
import sys

from pyspark.sql import functions as F

from quire import engine
from quire.functions import text as X
from quire.sources import models
from quire.sources.documents import PlainPages, RenderedPages, read_documents

PAGE_PROMPT = "Write down all text of this page, line by line, in the order in which a person reads it. Answer with the text only."
CROP_PROMPT = "Write down the text in this picture. Answer with the text only, or with nothing if there is none."
BOX_PROMPT = (
    'List every line of text on this page as a JSON array of objects {"bbox_2d": [left, top, right, bottom], "content": "the line"}, '
    "in pixels of the picture, one object for each line as printed. Answer with the array only."
)


def detector_of(name: str) -> models.Detector:
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def main(argv: list[str] | None = None) -> int:
    p = engine.parser()
    p.add_argument("--detector", default=os.environ.get("QUIRE_DETECTOR", ""), help="module:function that finds boxes; not needed with --grounded")
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.ERROR if args.quiet else logging.DEBUG if args.verbose else logging.WARNING, format="%(message)s")
    given = {k: v for k, v in (("base", args.api_base), ("model", args.model)) if v}
    reader = lambda prompt, limits, heat=0.1: models.ChatReader(prompt, *limits, heat, **given)
    spark = engine.session()
    docs = read_documents(spark, args.input)
    try:
        pages = RenderedPages() if importlib.util.find_spec("fitz") else PlainPages()
        settings = engine.settings_of(args)
        if args.grounded:
            result = engine.grounded(docs, reader(BOX_PROMPT, models.GROUNDED_LIMITS, 0.0), settings, pages)
        else:
            if not args.detector:
                p.error("--detector is needed without --grounded")
            result = engine.hybrid(docs, detector_of(args.detector), reader(PAGE_PROMPT, models.PAGE_LIMITS), reader(CROP_PROMPT, models.CROP_LIMITS), settings, pages)
        named = docs.select("doc_id", X.output_path(F.col("path"), F.lit(args.output)).alias("out"))
        # one file at a time: a command has few documents, a cluster job writes `output_files` itself
        for row in engine.output_files(result, docs, pages, settings.dpi).join(named, "doc_id").toLocalIterator():
            with open(row.out.removeprefix("file:"), "wb") as out:
                out.write(row.content)
    except Exception as e:
        print(f"failed: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
