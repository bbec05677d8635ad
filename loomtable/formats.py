"""Constants of stored formats and derived names."""

# They must be these for stored bytes and derived names to be interchangeable.
BATCH_MAGIC = b"ORSXCOL1"
BATCH_VERSION = 1
VECTOR_MAGIC = b"ORSX"
VECTOR_VERSION = 1
COPY_SIGNATURE = b"PGCOPY\n\xff\r\n\x00"
COPY_EPOCH_SHIFT_MICROS = 946_684_800_000_000
INDEX_PREFIX = "orsx"
OBJECT_PREFIX = "orsx2"
MIGRATION_KEY = "__orsx_mig_id"
FLATTEN_GENERATION = "orsx_flatten_module_v1"
NAME_LIMIT = 63
# Wire ids of batch column types and of vector element types.
COLUMN_TYPE_IDS = {"Bool": 1, "I16": 2, "I32": 3, "I64": 4, "F32": 5, "F64": 6, "Uuid": 7, "TimestampTzMicros": 8, "Utf8": 9, "Bytes": 10, "JsonbText": 11}
ELEMENT_TYPE_IDS = {"I32": 1, "I64": 2, "U32": 3, "U64": 4, "F32": 5, "F64": 6}
