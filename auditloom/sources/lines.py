"""The `lines` table: numbered lines of each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import LINE_BREAK, RARE_LINE_BREAK
from auditloom.schemas import carried


def line_cells(content: Column) -> Column:
    """The lines of a text as an array.

    A text that ends with a line break has no further empty line, and an empty text has
    no lines at all. Only texts with one of the rarer separators pay for a pattern split.
    """
    cells = F.when(content.rlike(RARE_LINE_BREAK), F.split(content, LINE_BREAK)).otherwise(F.split(content, "\n"))
    # Bound as a lambda variable, so that the text is split once.
    closed = F.transform(F.array(cells), lambda c: (
        F.when(F.element_at(c, -1) == "", F.slice(c, F.lit(1), F.size(c) - 1)).otherwise(c)
    ))
    return F.element_at(closed, 1)


def to_lines(files: DataFrame) -> DataFrame:
    """Explode content into (repo, path, is_test, line_no, line), numbered from 1.

    Nothing is shuffled: the explode runs in the scan's tasks.
    """
    kept = ["repo", "path", "is_test", *carried(files)]
    return files.select(*kept, F.posexplode(line_cells(F.col("content"))).alias("pos", "line")).select(
        *kept, (F.col("pos") + 1).alias("line_no"), "line"
    )


def texts_and_lines(files: DataFrame) -> DataFrame:
    """``to_lines`` with the whole text as line 0, for rules on texts and lines in one pass."""
    kept = ["repo", "path", "is_test", "is_py", "is_text", "is_dotenv", "size", *carried(files)]
    cells = F.concat(F.array("content"), F.when(F.col("is_py"), line_cells(F.col("content"))).otherwise(F.array()))
    return files.select(*kept, F.posexplode(cells).alias("line_no", "line"))
