"""Fixed schemas of the engine's tables."""

from pyspark.sql import types as T

_S, _L, _I, _B, _D = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


FILE = _struct(path=_S, name=_S, ext=_S, size_bytes=_L, mtime_secs=_L, mtime_nanos=_I)
DIGESTS = _struct(crc32=_S, sha1=_S, md5=_S, sha256=_S, size_bytes=_L)
DIGEST = T.StructType([*_struct(path=_S, scope=_S, track_number=_I, track_type=_S).fields, *DIGESTS.fields])
GAME = _struct(id=_S, name=_S, clone_of=_S, current_in_latest_dat=_B, last_seen_dat_version=_S)
GAME_FILE = _struct(id=_S, game_id=_S, file_name=_S, file_size_in_bytes=_L, crc=_S, md5=_S, sha1=_S, sha256=_S, current_in_latest_dat=_B, last_seen_dat_version=_S)
DAT_FILE = _struct(id=_S, name=_S, platform_id=_S, signature_group_id=_S, current_version=_S, subset=_S, tags=T.ArrayType(_S))
TRACK = _struct(number=_I, kind=_S, digests=DIGESTS)
CACHE = _struct(path=_S, size=_L, mtime_secs=_L, mtime_nanos=_I, raw=DIGESTS, decoded=DIGESTS, whole=DIGESTS, tracks=T.ArrayType(TRACK), members=T.ArrayType(_struct(size=_L, secs=_L, nanos=_I)), verify_valid=T.MapType(_S, _B))
CUE_TRACK = _struct(cue=_S, number=_I, track_type=_S, file_index=_I, file_name=_S, pregap_frames=_I, postgap_frames=_I, indices=T.ArrayType(_struct(number=_I, frames=_I)))
BLOCK = _struct(container=_S, block_no=_L, offset=_L, stored_len=_L, raw=_B, expected_len=_L)
MEMBER = _struct(container=_S, partition=_S, name=_S, offset=_L, size_bytes=_L, crc32=_S)
CONVERSION_REPORT = _struct(input_path=_S, output_path=_S, operation=_S, status=_S, input_bytes=_L, output_bytes=_L, ratio_pct=_D, elapsed_ms=_L, error=_S)
HASH_REPORT = _struct(path=_S, crc32=_S, sha1=_S, md5=_S, sha256=_S, size_bytes=_L, status=_S, elapsed_ms=_L, error=_S)
DAT_REPORT = _struct(path=_S, verdict=_S, game_name=_S, game_id=_S, platform=_S, signature_group=_S, dat_file_name=_S, dat_file_id=_S, dat_version=_S, match_algo=_S, detail=_S, size_bytes=_L, status=_S, elapsed_ms=_L, error=_S)
