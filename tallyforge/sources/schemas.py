"""Declared schemas of every input, as DDL text or StructType. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

COUNTER_LOG = "timestamp double, type string, running_pipelines int, waiting_pipelines int"

COMPONENT = "struct<name: string, type: string, state: string, node: string, platform: string, start_time: string, end_time: string, duration: double>"

# One object per run; times are text with an offset, components a map by name.
RUN_DUMP = (
    "id string, name string, kfp_id string, state string, submitted_at string, scheduled_at string, finished_at string, "
    f"duration double, components map<string, {COMPONENT}>"
)

KFP_RUNS = (
    "runs array<struct<run_id: string, display_name: string, state: string, created_at: string, scheduled_at: string, "
    "finished_at: string, run_details: struct<task_details: array<struct<display_name: string, start_time: string, "
    "end_time: string, state: string>>>>>"
)

_VERSION = "struct<n_samples: bigint, n_features: int, n_classes: int, input_shape: array<int>, data_types: map<string, int>>"
_LAYER = (
    "struct<type: string, input_shape: array<int>, output_shape: array<int>, params: bigint, kernel_size: array<int>, "
    "strides: array<int>, pool_size: array<int>>"
)

CATALOG = (
    "pipeline_id string, name string, submitted_at timestamp, components_type map<string, string>, "
    "dataset struct<name: string, type: string, train_percentage: double, val_percentage: double, test_percentage: double, "
    f"normalized: boolean, original: {_VERSION}, preprocessed: {_VERSION}>, "
    "model struct<type: string, params: struct<max_depth: int, n_estimators: int, n_iter: int, kernel: string, solver: string, "
    f"support_vectors: bigint, n_epochs: int, batch_size: int, macs: double, layers: array<{_LAYER}>>>"
)

ARRAYS_X = "idx bigint, pixels array<float>"
ARRAYS_Y = "idx bigint, label int"

# The column names of the headerless connection log, in file order.
CONNECTION_LOG_NAMES = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "land", "wrong_fragment", "urgent",
    "hot", "num_failed_logins", "logged_in", "num_compromised", "root_shell", "su_attempted", "num_root",
    "num_file_creations", "num_shells", "num_access_files", "num_outbound_cmds", "is_host_login", "is_guest_login",
    "count", "srv_count", "serror_rate", "srv_serror_rate", "rerror_rate", "srv_rerror_rate", "same_srv_rate",
    "diff_srv_rate", "srv_diff_host_rate", "dst_host_count", "dst_host_srv_count", "dst_host_same_srv_rate",
    "dst_host_diff_srv_rate", "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate", "dst_host_serror_rate",
    "dst_host_srv_serror_rate", "dst_host_rerror_rate", "dst_host_srv_rerror_rate", "label",
]
CONNECTION_LOG_TEXT = {"protocol_type", "service", "flag", "label"}

CONNECTION_LOG = T.StructType([
    T.StructField(n, T.StringType() if n in CONNECTION_LOG_TEXT
                  else T.DoubleType() if n.endswith("_rate") else T.LongType())
    for n in CONNECTION_LOG_NAMES
])
