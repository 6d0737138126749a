"""Questions answered as they arrive."""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from listingloom import fixed
from listingloom.plans.retrieve import Catalogue


def answer_stream(
    questions: DataFrame, catalogue: Catalogue, out: str, checkpoint: str, top_k: int = fixed.TOP_K, **trigger
) -> StreamingQuery:
    """Answer a stream of (question_id, text). Questions are independent, so no state is kept.

    Each micro-batch owns a folder that a retry overwrites, which makes the output exactly once.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        catalogue.answer(batch, top_k=top_k).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = questions.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
