"""Posts with their ranked comments, as one partitioned table."""

from __future__ import annotations

from argparse import ArgumentParser

from pyspark.sql import DataFrame

from corpusloom.operators import filters, joins, skew
from corpusloom.session import build_session
from corpusloom.sources import readers, writers


def denorm(posts: DataFrame, comments: DataFrame, list_limit: int = skew.GROUP_LIMIT) -> DataFrame:
    live = filters.drop_tombstones(filters.with_prefixed_key(posts, "id"), "selftext")
    needed = comments.select("id", "parent_id", "body", "ups", "score", "downs")
    return joins.denorm_posts_comments(live, needed, list_limit)


def denorm_job(spark, comments_path: str, posts_path: str, out: str, file_bytes: int = writers.FILE_BYTES) -> None:
    got = denorm(readers.read_table(spark, posts_path), readers.read_table(spark, comments_path))
    writers.write_partitioned(got, out, "subreddit", file_bytes)


def main() -> None:
    ap = ArgumentParser(description=__doc__)
    ap.add_argument("--comments_path", required=True)
    ap.add_argument("--posts_path", required=True)
    ap.add_argument("--output_path", required=True)
    a = ap.parse_args()
    denorm_job(build_session("denorm"), a.comments_path, a.posts_path, a.output_path)


if __name__ == "__main__":
    main()
