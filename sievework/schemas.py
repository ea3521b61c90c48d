"""Schemas of the records that flow through the library, as DDL strings."""

MESSAGE = "struct<role:string,content:string>"
TASK_FIELDS = "task_family string, task_kind string, task_schema string, task_key string"

SFT_ROW = f"query string, output string, output_type string, {TASK_FIELDS}"
LEGACY_SFT_ROW = "instruction string, requirements array<string>, output string"
TASK = (
    "task_id string, query string, feature_requirements string, task_name string, input_type string, "
    "output_type string, query_example string, VQA array<string>, raw_output_metric array<string>, "
    f"reference_output string, rendering boolean, {TASK_FIELDS}"
)
METADATA = (
    "struct<format:string,type:string,schema:string,complexity:string,prompt:string,output:string,"
    "final_output:string,answer:string,gold:string,target:string>"
)
#: Chat rows whose prompt and answer are kept in ``metadata``.
CHAT_WITH_METADATA = f"messages array<{MESSAGE}>, metadata {METADATA}"
#: Chat rows described by a category and a subcategory.
CHAT_WITH_CATEGORY = f"messages array<{MESSAGE}>, category string, subcategory string, task string"
CHAT_BUNDLED = f"messages array<array<{MESSAGE}>>, metadata array<{METADATA}>"
OFFLINE_ROW = (
    f"dataset string, output_format string, task_kind string, task_name string, messages array<{MESSAGE}>, "
    f"metadata {METADATA}, evaluation struct<grammar:struct<ok:boolean>,usable:boolean>"
)
PSEUDO_SFT_ROW = (
    "instruction string, output string, meta struct<source:string,task_id:string,output_type:string,variant_id:int,"
    "teacher_model:string,teacher_backend:string,teacher_prompt:string,raw_output_metric:array<string>,"
    "raw_generation:string,raw_used:string,parse_ok:boolean,json_parse_ok:boolean,syntax_strict_ok:boolean,"
    "output_only_ok:boolean,parse_error:string,error:string>"
)
INFERENCE_ROW = "task_id string, generation string"
SCORED_FIELDS = (
    "render_score double, key_validation_score double, raw_output_eval array<boolean>, "
    "raw_output_score double, final_eval_score double"
)
SCORED_ROW = f"{TASK}, generation string, {SCORED_FIELDS}"
ESCAPE_STATS = (
    "dataset string, format string, escape_type string, examples_total bigint, examples_usable bigint, "
    "examples_with_escape_total bigint, examples_with_escape_usable bigint, occurrences_total bigint, "
    "occurrences_usable bigint"
)
JUDGE_CACHE = (
    "provider string, model string, key string, score double, passed boolean, task_id string, "
    "task_ids array<string>, details string"
)
FEATURES = "input_ids array<int>, attention_mask array<int>, labels array<int>"
RUN_SUMMARY = "n bigint, avg_final_eval_score double"
