"""Java sources as fact tables: each file is parsed once, its rows are nested."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from factloom.lang.javaparse import Parsed, parse
from factloom.lang.lexer import coarse_tokens

_SOURCE = "struct<source:string,form:string,param:int>"
PARSED = (
    "relpath string, package string, status string, errors int, spans array<struct<line:int,text:string>>, "
    "types array<struct<fqn:string,simple:string,kind:string,supers:array<string>,line:int,end_line:int>>, "
    "methods array<struct<class_fqn:string,name:string,overload:int,params:array<struct<type:string,name:string>>,line:int,end_line:int,sink:boolean>>, "
    "calls array<struct<class_fqn:string,method:string,name:string,kind:string,receiver:string,receiver_type:string,args:array<string>,"
    f"sources:array<{_SOURCE}>,line:int,col:int>>, "
    "constants array<struct<class_name:string,const_name:string,literal:string,line:int>>, "
    "accesses array<struct<class_fqn:string,method:string,access:string,key:string,key_class:string,key_const:string,key_resolution:string,"
    "source:string,form:string,level:string,entry:string,param:int,via:string,receiver:string,line:int,col:int>>, "
    "annotations array<struct<class_fqn:string,member:string,name:string,value:string>>, "
    "tokens array<struct<kind:string,text:string,line:int,idiom:boolean>>"
)


def parse_files(files: DataFrame) -> DataFrame:
    """One row of nested facts for each file (relpath, text). A file that breaks the parser
    has the status ``failed`` and no facts; files without text are ``skipped``."""
    schema = files.sparkSession.createDataFrame([], PARSED).schema
    arrow = to_arrow_schema(schema)
    names = ["package", "status", "errors", "spans", "types", "methods", "calls", "constants", "accesses", "annotations"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column("relpath").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words: list = []
                if text is None:
                    found = Parsed(status="skipped")
                else:
                    try:
                        found, words = parse(text), coarse_tokens(text)
                    except (RecursionError, IndexError, ValueError):
                        found = Parsed(status="failed", errors=1)
                row = {"relpath": path, **{n: getattr(found, n) for n in names}}
                row["tokens"] = [dict(zip(("kind", "text", "line", "idiom"), w, strict=True)) for w in words]
                yield from pa.Table.from_pylist([row], arrow).to_batches()

    return files.select("relpath", "text").mapInArrow(read, schema)


def facts(parsed: DataFrame, column: str) -> DataFrame:
    """One nested column as a table, with the file's path."""
    return parsed.select("relpath", "package", F.explode(column).alias("x")).select("relpath", "package", "x.*")


def parse_report(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("status").agg(F.count("*").alias("files"), F.sum("errors").alias("errors"))
