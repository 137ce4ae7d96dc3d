"""Deterministic stand-ins for models, over pages of striped bars: what they say follows from the pixels."""

from __future__ import annotations

import json

import numpy as np

from quire.sources.documents import PlainPages, decoded, encoded

WIDTH, HEIGHT = 400, 600


def page(lines: list[int]) -> bytes:
    """White, with a dark striped bar for each line."""
    gray = np.full((HEIGHT, WIDTH), 255, np.uint8)
    for y in lines:
        gray[y : y + 20, 40:360:2] = 0
    return encoded(gray)


def detector(images: list[bytes]) -> list[list[tuple[float, float, float, float]]]:
    """Boxes of dark bars, and a blank one."""
    out = []
    for image in images:
        gray = decoded(image)
        dark = (gray < 128).any(axis=1).astype(int)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], dark, [0]])))
        out.append([(40, y0, 360, y1) for y0, y1 in zip(edges[::2], edges[1::2])] + [(40, 500, 360, 512)])
    return out


def reader(image: bytes) -> str:
    bars = len(detector([image])[0]) - 1
    return "---\nlang: en\n---\n" + "\n".join(f"line number {i} of the page" for i in range(bars))


def crop_reader(image: bytes) -> str:
    return "read again"


def grounded_reader(image: bytes) -> str:
    boxes = [{"bbox_2d": b, "content": f"block {i}"} for i, b in enumerate(detector([image])[0][:-1])]
    if len(boxes) == 1:
        raise RuntimeError("model is down")
    return "```json\n" + json.dumps([{k: [int(x) for x in v] if k == "bbox_2d" else v for k, v in b.items()} for b in boxes]) + "\n```"


def hosted_answer(content):
    """What a service says of a file of stand-in pages: corners in y before x, one block of no content, one of no page."""
    blocks = []
    for n, image in enumerate(PlainPages._images(content)):
        for k, (x0, y0, x1, y1) in enumerate(detector([encoded(image)])[0][:-1]):
            blocks.append({"block_content": f"block {k} of {n}", "bbox": [y0, x0, y1, x1], "block_id": k, "page_index": n, "block_label": "text", "score": 1.0})
    extra = [blocks[0] | {"block_label": "image"}, blocks[0] | {"block_content": "of no page", "page_index": 9}]
    pages = [{"width": WIDTH, "height": HEIGHT}] * 10
    return {"data": {"status": "completed", "layout": [{k: [int(x) for x in v] if k == "bbox" else v for k, v in b.items()} for b in blocks + extra], "data_info": {"pages": pages, "num_pages": 10}}}


class HostedService:
    """A service that is done when it is asked for the second time."""

    def __init__(self):
        self.content, self.times = b"", 0

    def __call__(self, what, content):
        if content is not None:
            self.content, self.times = content, 0
            return {"data": {"task_id": "t"}}
        self.times += 1
        return hosted_answer(self.content) if self.times > 1 else {"data": {"status": "running"}}
