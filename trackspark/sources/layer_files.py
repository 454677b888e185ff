"""A data source that writes layers as files of their own: one ``<video>_annotations_<layer>.json`` per video and layer.

Tasks write below a hidden folder of the job. Only when all have succeeded is this folder given its name, in a single
rename, so a reader sees a delivery whole or not at all; files of failed or repeated attempts are removed before, and a job
that fails leaves nothing. Plain file readers read the files: ``files.read_layers(spark, f"{path}/*/*/*.json")``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from trackspark.functions import names
from trackspark.sources.files import check_layer_path, layer_documents

#: A block that holds a whole layer, as a file does.
WHOLE_LAYER = 1 << 40


@dataclass
class Written(WriterCommitMessage):
    """The folder of a successful task, None if it had no rows."""

    folder: str | None


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class LayerFileWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    @property
    def staging(self) -> str:
        return f"{self.path}/_{self.job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        context = TaskContext.get()
        folder = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
        system, root = _filesystem(f"{self.staging}/{folder}")
        made = False
        for row in iterator:
            check_layer_path(row["file"])
            if "/" in row["file"]:
                raise ValueError(f"a file name has no folder: {row['file']}")
            if not made:
                system.create_dir(root, recursive=True)
                made = True
            with system.open_output_stream(f"{root}/{row['file']}") as out:
                out.write(row["document"].encode())
        return Written(folder if made else None)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _filesystem(self.staging)
        kept = {m.folder for m in messages if m is not None and m.folder}
        if not kept:
            return
        from pyarrow import fs

        for entry in system.get_file_info(fs.FileSelector(root)):
            if entry.base_name not in kept:  # an attempt that another one replaced
                system.delete_dir(entry.path)
        system.move(root, f"{root.rpartition('/')[0]}/delivery-{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _filesystem(self.staging)
        from pyarrow import fs

        if system.get_file_info(root).type != fs.FileType.NotFound:
            system.delete_dir(root)


class LayerFiles(DataSource):
    """Rows ``(file, document)`` as one file each."""

    @classmethod
    def name(cls) -> str:
        return "layer_files"

    def schema(self) -> str:
        return "file string, document string"

    def writer(self, schema: StructType, overwrite: bool) -> LayerFileWriter:
        if overwrite:
            raise ValueError("layer files are added to, not overwritten")
        return LayerFileWriter(self.options["path"])


def write_layer_files(points: DataFrame, declared: DataFrame, path: str) -> None:
    """Write every declared layer as a file of its own, all or none of them."""
    documents = layer_documents(points, declared, block=WHOLE_LAYER)
    name = names.layer_path(F.concat("video", F.lit(".mp4")), "layer")
    spark = points.sparkSession
    spark.dataSource.register(LayerFiles)
    documents.select(name.alias("file"), "document").write.format("layer_files").mode("append").save(path)


def read_layer_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Points and declared labels of what `write_layer_files` has written below a path."""
    from trackspark.sources.files import read_layers

    return read_layers(spark, f"{path}/delivery-*/*/*.json")
