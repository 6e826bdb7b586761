"""Explicit schemas of everything the engine reads or exchanges; nothing is inferred."""

from pyspark.sql import types as T

ITEM = "item_id long, path string, split string, class string, label int"
PREDICTION = T.StructType(
    [
        T.StructField("arm", T.StringType()),
        T.StructField("seed", T.IntegerType()),
        T.StructField("fold", T.IntegerType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("group_id", T.StringType()),
        T.StructField("true", T.StringType()),
        T.StructField("pred", T.StringType()),
        T.StructField("correct", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("probs", T.MapType(T.StringType(), T.DoubleType())),
    ]
)
PREDICTION_CSV = "path string, `group` string, true string, pred string, correct int, confidence double"
RUN_RESULT = (
    "map<string, struct<test_accuracy: double, macro_f1: double, macro_auc: double, n_test: int, n_errors: int, "
    "per_class_f1: map<string, double>, n_epochs_run: int, best_val_acc: double, seed: int, fold: int, grouped_val: boolean>>"
)
HISTORY = "train_loss array<double>, train_acc array<double>, val_loss array<double>, val_acc array<double>"
GROUP_MAP = "map<string, string>"
MANIFEST = (
    "mode string, cos_threshold double, n_removed int, n_removed_test int, n_removed_train int, "
    "kept map<string, map<string, int>>, removed map<string, string>"
)
