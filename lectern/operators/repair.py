"""Chapter repair: align stored segments with a fresh parse and change chapters alone, if there is exactly one way to align them."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern import schema
from lectern.sources.epub import Document
from lectern.store import Store

EXCERPT, SAMPLES = 80, 10


@dataclass
class Report:
    db_count: int = 0
    parsed_count: int = 0
    matched_count: int = 0
    legacy_titles: list[dict] = field(default_factory=list)
    changes: list[dict] = field(default_factory=list)
    issues: list[str] = field(default_factory=list)

    @property
    def valid(self) -> bool:
        return not self.issues

    @property
    def mappings(self) -> dict[tuple[str | None, str | None], int]:
        return dict(Counter((c["old_chapter"], c["new_chapter"]) for c in self.changes))


def chapter_changes(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """Segments of many editions whose chapter differs from the parsed one at the same place. Both: edition_id, seq, chapter; stored has id."""
    p = parsed.select("edition_id", "seq", F.col("chapter").alias("new_chapter"))
    both = stored.select("edition_id", "seq", F.col("id").alias("segment_id"), F.col("chapter").alias("old_chapter")).join(p, ["edition_id", "seq"])
    return both.where(~F.col("old_chapter").eqNullSafe(F.col("new_chapter")))


def misaligned(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """Editions that must not be repaired by place: counts, numbering or contents differ. A row each, with how many places do."""
    s = stored.select("edition_id", "seq", F.col("content").alias("a"))
    p = parsed.select("edition_id", "seq", F.col("content").alias("b"))
    both = s.join(p, ["edition_id", "seq"], "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).groupBy("edition_id").agg(F.count("*").alias("differences"))


def mapping_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("old_chapter", "new_chapter").agg(F.count("*").alias("n"))


def alignments(contents: list[str], documents: list[tuple[list[str], str | None]], most: int = 2) -> list[list[bool]]:
    """For each way (at most `most`) to lay the documents' blocks over contents: which documents have their title as a row before them.

    Forward over the documents, keeping for each row reached the ways that lead there; two are enough to tell that there is a choice.
    """
    ways: dict[int, list[list[bool]]] = {0: [[]]}
    for blocks, title in documents:
        after: dict[int, list[list[bool]]] = {}
        for at, paths in ways.items():
            for with_title in (False, True):
                begin = at + with_title
                if with_title and (title is None or at >= len(contents) or contents[at] != title):
                    continue
                if contents[begin : begin + len(blocks)] == blocks:
                    here = after.setdefault(begin + len(blocks), [])
                    here += [[*p, with_title] for p in paths][: most - len(here)]
        ways = after
    return ways.get(len(contents), [])


def numbering_issues(name: str, seqs: list[int]) -> list[str]:
    out = []
    if len(set(seqs)) != len(seqs):
        out.append(f"{name}: a place is taken twice")
    if seqs != list(range(1, len(seqs) + 1)):
        out.append(f"{name}: places do not run from 1 without gaps")
    return out


def first_difference(rows: list, documents: list[tuple[list[str], str | None]]) -> list[str]:
    """Where laying the documents over the rows one by one first fails, or what rows are left."""
    at = 0
    for blocks, title in documents:
        at += title is not None and at < len(rows) and rows[at]["content"] == title
        for block in blocks:
            if at >= len(rows):
                return [f"the rows end before {block[:EXCERPT]!r}"]
            if rows[at]["content"] != block:
                return [f"place {rows[at]['seq']}: stored {rows[at]['content'][:EXCERPT]!r}, parsed {block[:EXCERPT]!r}"]
            at += 1
    return [f"extra row at place {r['seq']}: {r['content'][:EXCERPT]!r}" for r in rows[at : at + SAMPLES]]


def plan(rows: list, parsed: list[tuple[int, str | None, str]], documents: list[Document] | None = None) -> Report:
    """rows: one edition's segments in order (id, seq, chapter, content); parsed: (seq, chapter, content)."""
    report = Report(len(rows), len(parsed))
    report.issues = numbering_issues("stored", [r["seq"] for r in rows]) + numbering_issues("parsed", [p[0] for p in parsed])
    fresh: list[str | None] = []
    if not report.issues and documents is not None:
        flat = [(c, b.text) for d in documents for c, b in zip(d.chapters, d.blocks, strict=False)]
        texts = [([b.text for b in d.blocks], d.page.raw_title) for d in documents]
        if any(len(d.chapters) != len(d.blocks) for d in documents):
            report.issues.append("a document's chapters and blocks differ in number")
        elif flat != [(c, t) for _, c, t in parsed]:
            report.issues.append("the documents are not what was parsed")
        else:
            ways = alignments([r["content"] for r in rows], texts)
            if not ways:
                report.issues += ["no alignment: text differs, or rows are there that are no title", *first_difference(rows, texts)]
            elif len(ways) > 1:
                report.issues.append("more than one alignment, as when text repeats")
            else:
                for d, titled in zip(documents, ways[0], strict=True):
                    chapters = list(d.chapters)
                    if titled:
                        row, new = rows[len(fresh)], chapters[0] if chapters else d.chapter
                        report.legacy_titles.append({"segment_id": row["id"], "seq": row["seq"], "old_chapter": row["chapter"], "new_chapter": new, "content": row["content"], "source_path": d.source_path})
                        fresh.append(new)
                    fresh += chapters
                report.matched_count = len(rows) - len(report.legacy_titles)
    elif not report.issues:
        if len(rows) != len(parsed):
            report.issues.append(f"{len(rows)} rows are stored, {len(parsed)} were parsed")
        report.issues += [f"place {r['seq']} (segment {r['id']}): the text differs" for r, p in zip(rows, parsed, strict=False) if r["content"] != p[2]]
        fresh, report.matched_count = [p[1] for p in parsed], 0 if report.issues else len(parsed)
    if report.valid:
        report.changes = [{"segment_id": r["id"], "seq": r["seq"], "old_chapter": r["chapter"], "new_chapter": c} for r, c in zip(rows, fresh, strict=True) if r["chapter"] != c]
    return report


def repair_edition(store: Store, edition_id: int, parsed: list[tuple[int, str | None, str]], documents: list[Document] | None = None, apply: bool = False) -> Report:
    """Plan against the newest version; with apply also publish the new chapters. RepairRefused where a plan to apply has issues.

    The rows are one edition's, a book, which is what the driver reads.
    """
    base = store.version()
    segments = store.edition(edition_id, base)
    rows = segments.select("id", "seq", "chapter", "content").orderBy("seq", "id").collect()
    report = plan(rows, parsed, documents)
    if not apply:
        return report
    if not report.valid:
        raise schema.RepairRefused(report)
    if report.changes:
        new = store.spark.createDataFrame([(c["segment_id"], c["new_chapter"]) for c in report.changes], "id long, new_chapter string").withColumn("changed", F.lit(True))
        fixed = segments.join(new, "id", "left").withColumn("chapter", F.when(F.col("changed"), F.col("new_chapter")).otherwise(F.col("chapter")))
        store.commit({}, base, {edition_id: fixed.select(*schema.SEGMENTS.names)})
    return report
