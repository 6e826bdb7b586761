"""The queries of this subpackage, and the SQL of those that SQL can express."""

from .ann import search
from .html_text import op7_html_text
from .language_id import op3_language_id
from .lattice_dedup import near_embeddings
from .line_dedup import OP1_SQL, op1_line_dedup
from .mixing import OP4_SQL, op4_mixing
from .ngram_join import op6_ngram_join
from .sentence_pieces import op8_sentence_pieces
from .toxicity import op2_toxicity
from .url_filter import OP5_SQL, op5_url_filter


def op9_lattice_dedup(spark, sf_dir: str):
    return near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_ann(spark, sf_dir: str):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 100 = 0"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_toxicity,
        op3_language_id,
        op4_mixing,
        op5_url_filter,
        op6_ngram_join,
        op7_html_text,
        op8_sentence_pieces,
        op9_lattice_dedup,
        op10_ann,
    )
}
ORACLE_SQL = {"op1_line_dedup": OP1_SQL, "op4_mixing": OP4_SQL, "op5_url_filter": OP5_SQL}
