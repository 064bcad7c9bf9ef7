"""Files that rows ask for by path, found by listing the folders asked for instead of everything below a root."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirador.operators.prepare import direct_paths, resolve_images
from mirador.sources.io import image_listing
from mirador.sources.scratch import Tables


def listed(folders: DataFrame) -> DataFrame:
    """The paths of all files right in the folders of folders (folder); absent folders have none. Executors list them, through
    file systems that pyarrow knows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in frames:
            for folder in pdf["folder"]:
                store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
                found = [x.base_name for x in store.get_file_info(fs.FileSelector(base or "/", allow_not_found=True)) if x.is_file]
                for i in range(0, len(found), 10_000):
                    yield pd.DataFrame({"path": [f"{folder}/{name}" for name in found[i : i + 10_000]]})

    return folders.mapInPandas(run, "path string")


def resolve_by_probing(rows: DataFrame, root: str) -> DataFrame:
    """resolve_images() over files that are looked for: each distinct folder that a path may mean is listed once, on the executors,
    an absolute path's own folder too. Only where rows are left without a file is everything below root listed, for these
    rows, to find them by name."""
    spark = rows.sparkSession
    with Tables(spark) as tables:
        asked = rows.select(F.explode(direct_paths(F.col("image_path"), root)).alias("p")).select(F.regexp_replace("p", "/[^/]*$", "").alias("folder")).distinct()
        near = tables.write(listed(asked.repartition("folder")), "listing")
        first = tables.write(resolve_images(rows, near, root, by_name=False), "resolved", keep=True)
        lost = first.where("image_path is null").select("pos")
        if lost.isEmpty():
            return first
        far = tables.write(resolve_images(rows.join(lost, "pos", "left_semi"), image_listing(spark, root), root), "resolved", keep=True)
    return first.where("image_path is not null").unionByName(far)
