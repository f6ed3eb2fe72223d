"""Document fingerprints: Merkle trees over blocks, paragraphs and sections.

A text is cut into paragraphs (lines) and sections (which end with blank lines),
and paragraphs into blocks, which end with a sentence or after a word with one
of the commonest last letters, so that cuts depend on content alone. Leaves are hashes of
blocks. A paragraph hashes its leaves and the white space that follows it, a
section its paragraphs, and the root its sections, so that the tree binds every
character: equal texts have equal roots, and texts that differ have differing ones.
Where roots differ, walking down the differing branches finds the edits. The
fingerprint lists the whole tree, shortened; likeness goes down it likewise.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

#: Hex digits of a node and of the root in a fingerprint.
NODE, ROOT = 6, 32
#: Characters of a block at least (but for the last one of a paragraph), and at most.
SHORT, LONG = 12, 160

_BLOCK = re.compile(rf".{{{SHORT},{LONG}}}?(?:[.!?]+\s*|(?<=[estndr])\s+)|.{{1,{LONG}}}", re.S)
_PARAGRAPH = re.compile(r"([^\n]*[^\n\s][^\n]*)((?:\n[^\S\n]*(?=\n|\Z))*\n?)|([\s]+)")
_digest = xxhash.xxh3_128_hexdigest


def blocks(paragraph: str) -> list[str]:
    """The blocks of a paragraph; joined they give the paragraph."""
    return _BLOCK.findall(paragraph)


def paragraphs(text: str) -> list[tuple[str, str]]:
    """Lines with text, each with the line ends and blank lines after it; white space before the first one stands alone."""
    return [(m[1] or "", m[2] or m[3] or "") for m in _PARAGRAPH.finditer(text)]


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


Section = tuple[str, list[tuple[str, list[str]]]]


def tree(text: str) -> tuple[str, list[Section]]:
    """The root's hash, and sections with their paragraphs with their leaves' hashes."""
    sections: list[Section] = []
    held: list[tuple[str, list[str]]] = []
    for line, after in paragraphs(text):
        leaves = [_digest(_bytes(b)) for b in blocks(line)]
        held.append((_digest("/".join(leaves) + "|" + _digest(_bytes(after))), leaves))
        if after.count("\n") > 1:
            sections.append((_digest("/".join(h for h, _ in held)), held))
            held = []
    if held:
        sections.append((_digest("/".join(h for h, _ in held)), held))
    return hashlib.sha256("/".join(h for h, _ in sections).encode()).hexdigest()[:ROOT], sections


def fingerprint(text: str) -> str:
    """``root:section=paragraph-leaf leaf;paragraph-...|section=...``, hashes of fixed width, leaves run on."""
    root, sections = tree(text)
    return f"{root}:" + "|".join(
        f"{h[:NODE]}=" + ";".join(f"{p[:NODE]}-" + "".join(x[:NODE] for x in leaves) for p, leaves in inner) for h, inner in sections
    )


def likeness(a: str, b: str) -> float:
    """Shared leaves over all leaves of two fingerprints, repeats counted; 1 for equal roots, 0 if one has no leaf.

    Goes down the trees: sections that both have count whole, without a look
    at what is in them; of the others the paragraphs are compared, and of the
    paragraphs that only one has the leaves.
    """
    if a[:ROOT] == b[:ROOT]:
        return 1.0
    one, two = (Counter(fp[ROOT + 1 :].split("|") if len(fp) > ROOT + 1 else ()) for fp in (a, b))
    shared = sum(_leaves(node) * n for node, n in (one & two).items())
    total = sum(_leaves(node) * n for side in (one, two) for node, n in side.items())
    one, two = (Counter(p for node, n in side.items() for p in node[NODE + 1 :].split(";") * n) for side in (one - two, two - one))
    shared += sum(_leaves(node) * n for node, n in (one & two).items())
    one, two = (Counter(leaf for node, n in side.items() for leaf in _cut(node[NODE + 1 :]) * n) for side in (one - two, two - one))
    shared += sum((one & two).values())
    return shared / max(1, total - shared)


def _cut(leaves: str) -> list[str]:
    return [leaves[i : i + NODE] for i in range(0, len(leaves), NODE)]


def _leaves(node: str) -> int:
    """Leaves of a section or paragraph as the fingerprint lists it."""
    inner = node.split("=")[-1]
    return sum((len(p) - NODE - 1) // NODE for p in inner.split(";"))


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """Where texts of two trees differ: (section, paragraph) of the first, by differing branches.

    Equal roots give none. Only sections whose hashes differ at a place are
    looked into; a section or paragraph that the second lacks differs.
    """
    (root_a, one), (root_b, two) = tree(a), tree(b)
    if root_a == root_b:
        return []
    out = []
    for i, (h, inner) in enumerate(one):
        other = two[i] if i < len(two) else ("", [])
        if h != other[0]:
            out += [(i, j) for j, (p, _) in enumerate(inner) if j >= len(other[1]) or p != other[1][j][0]]
    return out


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the start of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "id {}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and likeness to that and to the next document.

    The next document is that of the next smaller id, after the last the
    first; rows of one id follow each other by text; null ids come last. A
    null text counts as empty. A table of one row is its own successor; an
    empty table gives an empty result; other columns are left out, whatever
    their names. Ids must be numbers. Very long texts are read whole; a task
    holds one and its successor.

    One exchange by ranges of the id, a range a partition, puts neighbours
    side by side. The successor of a range's last row is the first of the
    next range, which is added to the range beforehand (a row a range).
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    cuts = base.agg(F.percentile_approx("id", [k / n for k in range(1, n)] or [0.5], 100 * n)).first()[0]
    cuts = sorted(set(cuts or []))
    # the bucket of an id: how many cuts lie below it, by binary search
    bucket = F.coalesce(F.expr(_search(cuts, "id")), F.lit(-1)) if cuts else F.lit(0)
    base = base.withColumn("bucket", bucket.cast("int"))
    # a bucket's first row in descending order; at most n rows, of ids alone
    heads = base.groupBy("bucket").agg(F.max("id").alias("head")).orderBy(F.desc("bucket")).collect()
    if not heads:
        return spark.createDataFrame([], SCHEMA.format(kind)).withColumnRenamed("id", id_col)
    # the first row of each bucket follows the last row of the bucket above it
    rows = [(heads[i - 1].bucket, h.bucket, h.head) for i, h in enumerate(heads)]
    marks = spark.createDataFrame(rows, f"to_bucket int, at int, head {kind}")
    first = (
        base.join(F.broadcast(marks), [base["bucket"] == marks["at"], base["id"].eqNullSafe(marks["head"])])
        .groupBy("to_bucket", "id")
        .agg(F.min("text").alias("text"))
        .select("id", "text", F.col("to_bucket").alias("bucket"), F.lit(1).alias("extra"))
    )
    dealt = (
        base.withColumn("extra", F.lit(0))
        .unionByName(first)
        .repartitionById(len(cuts) + 2, F.col("bucket") + 1)
        .sortWithinPartitions("bucket", "extra", F.desc_nulls_last("id"), "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # id, text, fingerprint
        for batch in slices(batches, "text"):
            out: list[tuple] = []
            for i, text, extra in zip(*(batch.column(k).to_pylist() for k in ("id", "text", "extra"))):
                own = fingerprint(text)
                if held is not None:
                    out.append(_row(*held, text, own))
                held = None if extra else (i, text, own)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(zip(*out), [batch.schema.field("id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()])],
                    ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return dealt.mapInArrow(run, SCHEMA.format(kind)).withColumnRenamed("id", id_col)


def _search(cuts: list, name: str) -> str:
    """A nested CASE that finds how many cuts are smaller than a value."""

    def part(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"CASE WHEN {name} > {cuts[mid]!r} THEN {part(mid + 1, hi)} ELSE {part(lo, mid)} END"

    return f"CASE WHEN {name} IS NOT NULL THEN {part(0, len(cuts))} END"


def _row(i, text: str, own: str, following: str, following_fp: str) -> tuple:
    changed = edited(text, following)
    theirs = own if changed == text else fingerprint(changed)
    return (
        i,
        len(text),
        hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
        own,
        theirs,
        likeness(own, theirs),
        likeness(own, following_fp),
    )
