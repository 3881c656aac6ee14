"""All key-space commands by name, with their arity: the number of words, or, if negative, the least number."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.operators.kv import geo, hashes, keys, lists, sets, strings, zsets
from tessera.operators.kv.base import Command, KeySpace, Written, fail

# Names and arities.
COMMANDS: dict[str, tuple[Command, int]] = {
    "DEL": (keys.delete, -2), "UNLINK": (keys.delete, -2), "EXISTS": (keys.exists, -2), "TOUCH": (keys.exists, -2), "TYPE": (keys.type_, 2),
    "RENAME": (keys.rename, 3), "RENAMENX": (keys.renamenx, 3), "KEYS": (keys.keys, 2), "RANDOMKEY": (keys.randomkey, 1), "MOVE": (keys.move, 3),
    "DBSIZE": (keys.dbsize, 1), "FLUSHDB": (keys.flushdb, -1), "FLUSHALL": (keys.flushall, -1),
    "EXPIRE": (keys.expire, -3), "PEXPIRE": (keys.pexpire, -3), "EXPIREAT": (keys.expireat, -3), "PEXPIREAT": (keys.pexpireat, -3),
    "TTL": (keys.ttl, 2), "PTTL": (keys.pttl, 2), "EXPIRETIME": (keys.expiretime, 2), "PEXPIRETIME": (keys.pexpiretime, 2), "PERSIST": (keys.persist, 2),
    "SCAN": (keys.scan, -2), "HSCAN": (keys.hscan, -3), "SSCAN": (keys.sscan, -3), "ZSCAN": (keys.zscan, -3),
    "SET": (strings.set_, -3), "GET": (strings.get, 2), "GETDEL": (strings.getdel, 2), "GETEX": (strings.getex, -2), "GETSET": (strings.getset, 3),
    "MGET": (strings.mget, -2), "MSET": (strings.mset, -3), "MSETNX": (strings.msetnx, -3), "SETNX": (strings.setnx, 3), "SETEX": (strings.setex, 4), "PSETEX": (strings.psetex, 4),
    "INCR": (strings.incr, 2), "DECR": (strings.decr, 2), "INCRBY": (strings.incrby, 3), "DECRBY": (strings.decrby, 3), "INCRBYFLOAT": (strings.incrbyfloat, 3),
    "APPEND": (strings.append, 3), "STRLEN": (strings.strlen, 2), "GETRANGE": (strings.getrange, 4), "SUBSTR": (strings.getrange, 4), "SETRANGE": (strings.setrange, 4),
    "HSET": (hashes.hset, -4), "HSETNX": (hashes.hsetnx, 4), "HGET": (hashes.hget, 3), "HMGET": (hashes.hmget, -3), "HMSET": (hashes.hmset, -4), "HDEL": (hashes.hdel, -3),
    "HLEN": (hashes.hlen, 2), "HEXISTS": (hashes.hexists, 3), "HSTRLEN": (hashes.hstrlen, 3), "HKEYS": (hashes.hkeys, 2), "HVALS": (hashes.hvals, 2), "HGETALL": (hashes.hgetall, 2),
    "HINCRBY": (hashes.hincrby, 4), "HINCRBYFLOAT": (hashes.hincrbyfloat, 4), "HRANDFIELD": (hashes.hrandfield, -2),
    "LPUSH": (lists.lpush, -3), "RPUSH": (lists.rpush, -3), "LPUSHX": (lists.lpushx, -3), "RPUSHX": (lists.rpushx, -3), "LPOP": (lists.lpop, -2), "RPOP": (lists.rpop, -2),
    "LLEN": (lists.llen, 2), "LRANGE": (lists.lrange, 4), "LINDEX": (lists.lindex, 3), "LSET": (lists.lset, 4), "LREM": (lists.lrem, 4), "LTRIM": (lists.ltrim, 4),
    "LINSERT": (lists.linsert, 5), "LPOS": (lists.lpos, -3), "LMOVE": (lists.lmove, 5), "RPOPLPUSH": (lists.rpoplpush, 3),
    "SADD": (sets.sadd, -3), "SREM": (sets.srem, -3), "SMEMBERS": (sets.smembers, 2), "SISMEMBER": (sets.sismember, 3), "SMISMEMBER": (sets.smismember, -3), "SCARD": (sets.scard, 2),
    "SPOP": (sets.spop, -2), "SRANDMEMBER": (sets.srandmember, -2), "SMOVE": (sets.smove, 4), "SINTER": (sets.sinter, -2), "SUNION": (sets.sunion, -2), "SDIFF": (sets.sdiff, -2),
    "SINTERSTORE": (sets.sinterstore, -3), "SUNIONSTORE": (sets.sunionstore, -3), "SDIFFSTORE": (sets.sdiffstore, -3), "SINTERCARD": (sets.sintercard, -3),
    "ZADD": (zsets.zadd, -4), "ZINCRBY": (zsets.zincrby, 4), "ZREM": (zsets.zrem, -3), "ZSCORE": (zsets.zscore, 3), "ZMSCORE": (zsets.zmscore, -3), "ZCARD": (zsets.zcard, 2),
    "ZCOUNT": (zsets.zcount, 4), "ZLEXCOUNT": (zsets.zlexcount, 4), "ZRANGE": (zsets.zrange, -4), "ZRANGESTORE": (zsets.zrangestore, -5), "ZREVRANGE": (zsets.zrevrange, -4),
    "ZRANGEBYSCORE": (zsets.zrangebyscore, -4), "ZREVRANGEBYSCORE": (zsets.zrevrangebyscore, -4), "ZRANGEBYLEX": (zsets.zrangebylex, -4), "ZREVRANGEBYLEX": (zsets.zrevrangebylex, -4),
    "ZRANK": (zsets.zrank, -3), "ZREVRANK": (zsets.zrevrank, -3), "ZPOPMIN": (zsets.zpopmin, -2), "ZPOPMAX": (zsets.zpopmax, -2), "ZRANDMEMBER": (zsets.zrandmember, -2),
    "ZREMRANGEBYRANK": (zsets.zremrangebyrank, 4), "ZREMRANGEBYSCORE": (zsets.zremrangebyscore, 4), "ZREMRANGEBYLEX": (zsets.zremrangebylex, 4),
    "ZUNIONSTORE": (zsets.zunionstore, -4), "ZINTERSTORE": (zsets.zinterstore, -4), "ZDIFFSTORE": (zsets.zdiffstore, -4),
    "ZUNION": (zsets.zunion, -3), "ZINTER": (zsets.zinter, -3), "ZDIFF": (zsets.zdiff, -3), "ZINTERCARD": (zsets.zintercard, -3),
    "GEOADD": (geo.geoadd, -5), "GEOPOS": (geo.geopos, -2), "GEODIST": (geo.geodist, -4), "GEOHASH": (geo.geohashes, -2), "GEOSEARCH": (geo.geosearch, -7), "GEOSEARCHSTORE": (geo.geosearchstore, -8),
    "GEORADIUS": (geo.georadius, -6), "GEORADIUSBYMEMBER": (geo.georadiusbymember, -5), "GEORADIUS_RO": (geo.georadius_ro, -6), "GEORADIUSBYMEMBER_RO": (geo.georadiusbymember_ro, -5),
}


def run(space: KeySpace, name: str, *args: object) -> DataFrame | Written:
    """A command by its name, with its arguments as words."""
    if name.upper() not in COMMANDS:
        raise fail(f"unknown command '{name}'")
    command, arity = COMMANDS[name.upper()]
    words = len(args) + 1
    if words != arity if arity > 0 else words < -arity:
        raise fail(f"wrong number of arguments for '{name.lower()}' command")
    if command.__module__ != keys.__name__:
        space.learn([a for a in args if isinstance(a, str)])
    return command(space, *args)
