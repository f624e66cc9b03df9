"""A decoder for plain text, as a plug-in that needs no other library."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from .files import PAGES, Plugins

PAGE_BREAK = "\f"
_COLUMNS = ("dossier_id", "doc_id", "page_no", "width", "height", "text", "n_images")
_KINDS = (pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.int32())


def text_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files (dossier_id, doc_id, content) to pages, parted at form feeds.  Bytes that are no UTF-8 become U+FFFD; a file
    without content has one page without text."""
    for batch in batches:
        c = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        rows = [
            (dossier, doc, no, None, None, page or None, 0)
            for dossier, doc, content in zip(c["dossier_id"], c["doc_id"], c["content"])
            for no, page in enumerate((content or b"").decode("utf-8", "replace").split(PAGE_BREAK), 1)
        ]
        columns = list(zip(*rows)) or [()] * len(_COLUMNS)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, _KINDS)], names=list(_COLUMNS))


def plain_text() -> Plugins:
    """Plug-ins with the plain-text decoder in the slot for pages."""
    out = Plugins()
    out.register("pdf_pages", text_pages, PAGES)
    return out
