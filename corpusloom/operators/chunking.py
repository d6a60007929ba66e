"""Sections and packs of a page cut into word windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import fixed, text
from corpusloom.operators import filters, neardup


def infobox_text(infobox: Column | str, valid_keys: Sequence[str] = fixed.INFOBOX_KEYS) -> Column:
    """" k: v; k: v" over the wanted parameters of every box; boxes follow each other."""
    c = F.col(infobox) if isinstance(infobox, str) else infobox
    box = lambda m: F.array_join(
        F.transform(
            F.filter(F.map_entries(m), lambda e: e["key"].isin(*valid_keys)),
            lambda e: F.concat(F.lit(" "), e["key"], F.lit(": "), e["value"]),
        ),
        ";",
    )
    return F.array_join(F.array_remove(F.transform(F.map_values(c), box), ""), ";")


def with_extra_sections(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Add the infobox text and the summary of `pages` (page_id, title, summary, infobox) as
    sections; each replaces a section of the same name."""
    extra = pages.select(
        "page_id", "title",
        F.inline(
            F.array(
                F.struct(F.lit(2147483646).alias("pos"), F.lit(fixed.INFOBOX_HEADING).alias("heading"),
                         infobox_text("infobox").alias("content")),
                F.struct(F.lit(2147483647).alias("pos"), F.lit("Summary").alias("heading"),
                         F.coalesce(F.col("summary"), F.lit("")).alias("content")),
            )
        ),
    ).where("content <> ''")
    kept = sections.join(extra.select("page_id", "heading"), ["page_id", "heading"], "left_anti")
    return kept.select("page_id", "title", "pos", "heading", "content").unionByName(
        extra.select("page_id", "title", F.col("pos").cast("int").alias("pos"), "heading", "content")
    )


def _windows(words: Column, step: Column | int, size: Column | int) -> Column:
    """Array of (no, chunk, words in it); NULL when there are no words."""
    step, size = (F.lit(x) if isinstance(x, int) else x for x in (step, size))
    starts = F.sequence(F.lit(0), F.size(words) - 1, step)
    cut = F.transform(starts, lambda at, i: F.struct(
        i.alias("no"), F.array_join(F.slice(words, at + 1, size), " ").alias("chunk"),
        F.least(size, F.size(words) - at).alias("n"),
    ))
    return F.when(F.size(words) > 0, cut)


def _cut_by_plans(df: DataFrame, plans: Sequence[tuple[int, int, int, int]], floor: float, seed: int) -> DataFrame:
    """Rows of all `plans` (context length, overlap, step, window) from one pass over the sections; each text is cut into words once."""
    # A window that is too short for the floor gives no row, so it is not cut; one plan stays, to give the columns.
    plans = [p for p in plans if p[3] * fixed.TOKENS_PER_WORD >= floor] or plans[-1:]
    each = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("context_length", "overlap", "step", "size"), p, strict=True)]) for p in plans])
    words = df.withColumn("_w", text.tokens("content")).select("page_id", "title", "pos", "heading", "_w", F.inline(each))
    cut = words.select(
        "context_length", "overlap", "page_id", "title", "pos", "heading", F.inline_outer(_windows(F.col("_w"), F.col("step"), F.col("size")))
    ).where("chunk IS NOT NULL")  # an inner `inline` would build the windows twice, to filter on their number
    cut = cut.where(F.col("n") * F.lit(fixed.TOKENS_PER_WORD) >= floor)
    topic = F.when(
        F.pmod(text.unit_hash("page_id", "pos", "no", F.lit(seed)), F.lit(2)) == 0,
        F.concat("heading", F.lit(" of "), "title"),
    ).otherwise(F.concat("title", F.lit("'s "), "heading"))
    return cut.select(
        "context_length", "overlap", "page_id", "pos", F.col("no").alias("chunk_no"), topic.alias("input"),
        text.choose(fixed.TOPIC_INSTRUCTIONS, "page_id", "pos", "no", F.lit(seed + 1)).alias("instruction"),
        text.hashes_to_space("chunk").alias("response"),
    )


def section_chunks(
    df: DataFrame, max_len: int, overlap: int, floor: float = 30, seed: int = 0, true_overlap: bool = False
) -> DataFrame:
    """Sections (page_id, title, pos, heading, content) to rows with input, instruction, response.

    As the name says in the source data's tradition, `overlap` shortens the window: step and
    window are both max_len - overlap, so neighbours share nothing. `true_overlap` keeps the
    window at max_len and only steps by the difference.
    """
    step = max(max_len - overlap, 1)
    return _cut_by_plans(df, [(max_len, overlap, step, max_len if true_overlap else step)], floor, seed).drop("context_length", "overlap")


def packed_chunks(df: DataFrame, max_len: int, overlap: int, floor: float = 5, seed: int = 0) -> DataFrame:
    """Pages (page_id, title, summary, text, sections: array<struct<heading,content>>, infobox_text)
    to windows over packs of whole sections.

    A page under the limit is one pack, "title, summary, text" plus infobox. Otherwise sections
    are added while the running estimate fits, and each pack opens with the title, or title and
    summary. The fold runs inside a row, so pages are processed in parallel.
    """
    box = F.coalesce(F.col("infobox_text"), F.lit(""))
    whole = F.concat(
        F.concat_ws(", ", "title", F.coalesce("summary", F.lit("")), F.coalesce("text", F.lit(""))),
        F.when(box != "", F.concat(F.lit(f"\n{fixed.INFOBOX_HEADING}: "), box)).otherwise(F.lit("")),
    )
    contents = F.concat(
        F.transform("sections", lambda s: s["content"]),
        F.when(box != "", F.array(box)).otherwise(F.array().cast("array<string>")),
    )

    def opening(no: Column) -> Column:
        long = F.concat("title", F.lit("."), F.coalesce("summary", F.lit("")))
        return F.when(F.pmod(text.unit_hash("page_id", no, F.lit(seed)), F.lit(2)) == 0, long).otherwise(F.col("title"))

    def state(done: Column, cur: Column, tok: Column) -> Column:
        return F.struct(done.alias("done"), cur.alias("cur"), tok.alias("tok"))

    def add(acc: Column, content: Column) -> Column:
        t = text.est_tokens(content)
        head = opening(F.size(acc["done"]) + 1)
        over = acc["tok"] + t > max_len
        return state(
            F.when(over, F.concat(acc["done"], F.array(F.array_join(acc["cur"], "\n")))).otherwise(acc["done"]),
            F.when(over, F.array(head, content)).otherwise(F.concat(acc["cur"], F.array(content))),
            F.when(over, text.est_tokens(head) + t).otherwise(acc["tok"] + t),
        )

    start = state(F.array().cast("array<string>"), F.array(opening(F.lit(0))), text.est_tokens(opening(F.lit(0))))
    packs = F.aggregate(
        contents, start, add, lambda acc: F.concat(acc["done"], F.array(F.array_join(acc["cur"], "\n ")))
    )
    step = max(max_len - overlap, 1)
    got = df.withColumn("_whole", whole).select(
        "page_id", "title",
        F.posexplode_outer(F.when(text.est_tokens("_whole") >= max_len, packs).otherwise(F.array("_whole"))).alias("pack", "body"),
    )
    got = got.withColumn("_w", text.tokens("body")).select(
        "page_id", "title", "pack", F.inline_outer(_windows(F.col("_w"), step, step))
    ).where("chunk IS NOT NULL")
    got = got.withColumn("input", F.concat("title", F.lit(", "), "chunk"))
    return got.where(text.est_tokens("input") >= floor).select(
        "page_id", "pack", F.col("no").alias("chunk_no"), "input", F.lit("").alias("response")
    )


def chunk_sweep(
    sections: DataFrame, lengths: Sequence[int] = (512, 1024, 2048), min_tokens: int = 60,
    deny: Sequence[str] = (), first_overlap: int = 200, grow: int = 200, num_perm: int | None = 32, dedup: bool = True,
    seed: int = 0,
) -> DataFrame:
    """Section chunks for every context length: (context_length, overlap, over_length, page_id, pos, chunk_no, input, instruction, response).

    A length takes the first of the overlaps `first_overlap`, `first_overlap` + `grow`, ... at which no row's estimate passes it; where
    none does, the last one, whose window is a single word, and rows still over the length are marked `over_length`. Overlaps are judged in
    this order up to the first that fits, and the rows of all lengths come from one job. Rows are then filtered by deny-list and floor, and near-duplicates by response
    within a length are dropped.
    """
    tries: list[tuple[int, int, int, int]] = []
    for length in lengths:
        overlap = first_overlap
        while True:
            step = max(length - overlap, 1)
            tries.append((length, overlap, step, step))
            if step == 1:
                break
            overlap += grow
    size = text.est_tokens(F.concat("input", "instruction", "response"))
    over = size > F.col("context_length")

    def fits(plan: tuple[int, int, int, int]) -> bool:
        # Stops at the first row over the length, so a try that fails early is not read to the end.
        return _cut_by_plans(sections, [plan], min_tokens, seed).where(over).isEmpty()

    of = {n: [t for t in tries if t[0] == n] for n in lengths}
    chosen = [next((t for t in some[:-1] if fits(t)), some[-1]) for some in of.values()]
    rows = _cut_by_plans(sections, chosen, min_tokens, seed).withColumn("over_length", over)
    rows = filters.filter_denylist(rows, "input", deny).where(text.word_count("response") >= min_tokens)
    if dedup:
        # Marked by length, so that rows of different lengths share no shingle and one search serves all.
        place = [F.lpad(F.col(c).cast("string"), 10, "0") for c in ("context_length", "pos", "chunk_no")]
        mark = F.concat(F.col("context_length").cast("string"), F.lit(":"))
        rows = rows.withColumn("_id", F.concat_ws("-", place[0], "page_id", *place[1:]))
        rows = rows.withColumn("_r", F.array_join(F.transform(text.tokens("response"), lambda w: F.concat(mark, w)), " "))
        rows = neardup.dedup_near(rows, "_id", "_r", 10, 0.7, num_perm).drop("_id", "_r")
    return rows.select("context_length", "overlap", "over_length", "page_id", "pos", "chunk_no", "input", "instruction", "response")
