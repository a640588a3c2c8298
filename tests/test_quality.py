"""Retrieval quality on a quiz of three pages: recall at the pool and the final cut, precision at the final cut."""

from pyspark.sql import functions as F

from docloom.config import Config
from docloom.functions import params
from docloom.operators import evaluation
from docloom.operators.chunking import chunk_pages
from docloom.operators.embedding import embedder

#: Questions and pages that the figures are known for. Fixed values.
QUIZ = [
    ("中国的首都是哪座城市？", 1, "B. 北京", "A. 上海\nB. 北京\nC. 广州\nD. 西安\n答案：B\n2. 一年中有几个月份是 31 天？\nA. 5 个\nB. 6 个\nC. 7 个\nD. 8 个\n答案：C\n3. 人体最大的器官是什么？\nA. 肝脏\nB. 心脏\nC. 大脑\nD. 皮肤\n答案：D"),
    ("光在真空中的传播速度约为每秒多少？", 2, "B. 30 万公里", "A. 3 万公里\nB. 30 万公里\nC. 300 万公里\nD. 3000 公里\n答案：B\n2. 下列哪种动物不是哺乳动物？\nA. 鲸鱼\nB. 蝙蝠\nC. 海豚\nD. 鳄鱼\n答案：D\n3. 《红楼梦》的作者是谁？\nA. 施耐庵\nB. 罗贯中\nC. 曹雪芹\nD. 吴承恩\n答案：C"),
    ("地球绕太阳公转一圈大约需要多少天？", 3, "B. 约 365 天", "A. 约 30 天\nB. 约 365 天\nC. 约 24 天\nD. 约 100 天\n答案：B\n2. 水的化学式是什么？\nA. CO\nB. O\nC. HO\nD. NaCl\n答案：C\n3. 端午节是为了纪念哪位历史人物？\nA. 屈原\nB. 李白\nC. 岳飞\nD. 杜甫\n答案：A"),
]


def test_quiz(spark):
    rows = [("quiz", page, f"常识题练习\n第 {page} 页 / 共 3 页\n1. {q}\n{rest}\n— 学而时习之，不亦说乎 —", "pdf") for q, page, _, rest in QUIZ]
    pages = spark.createDataFrame(rows, "doc_id string, page int, text string, source_ext string")
    chunks = chunk_pages(pages).withColumn("embedding", embedder()("text"))
    assert chunks.count() == 3
    cases = spark.createDataFrame([(i, "quiz", q, [page], [text]) for i, (q, page, text, _) in enumerate(QUIZ)], "query_id int, doc_id string, question string, gold_pages array<int>, gold_contains array<string>")
    asked = cases.select("query_id", "doc_id", "question", embedder()("question").alias("q_embedding"))
    assert spark.range(1).select(params.top_k(F.lit(3))).first()[0] == 2
    pool, final = evaluation.pool_and_final(asked, chunks, Config(), space="cosine")
    at = {name: evaluation.summary(evaluation.metrics(cases, hits)).first() for name, hits in (("pool", pool), ("final", final))}
    assert (at["pool"].page_recall, at["pool"].text_recall, at["final"].page_recall, at["final"].text_recall) == (1.0, 1.0, 1.0, 1.0)
    print("precision at the final cut", at["final"].page_precision, at["final"].text_precision)
    assert at["final"].page_precision >= 0.5 and at["final"].text_precision >= 0.5
