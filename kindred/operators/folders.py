"""Reports on folders: leftovers that nothing claims, things installed twice or idle, owners of dumps, reports by category."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import names
from kindred.operators.reasons import first_reason


def leftovers(folders: DataFrame, claimed: DataFrame, folder: str, size: str, least: int) -> DataFrame:
    """Folders of ``least`` bytes or more that no manifest claims."""
    return folders.where(F.col(size) >= least).join(claimed.select(folder).distinct(), folder, "left_anti")


def installed_twice(games: DataFrame, name: str, folder: str, size: str) -> DataFrame:
    """(name_key, folders, reclaim): names, written as any launcher might, in more than one folder; all but the largest could go."""
    keyed = games.select(names.plain_name(F.col(name)).alias("name_key"), F.lower(folder).alias("folder"), F.col(size).alias("size")).where("name_key != ''")
    out = keyed.groupBy("name_key").agg(F.count_distinct("folder").alias("folders"), (F.sum("size") - F.max("size")).alias("reclaim"))
    return out.where("folders > 1")


def idle(games: DataFrame, played: Column, updated: Column, now: Column, days: int = 90) -> DataFrame:
    """Games not played for ``days``; those never played count from their last update."""
    return games.where(F.coalesce(played, updated) < now - F.make_interval(days=F.lit(days)))


def dump_owners(dumps: DataFrame, dump: str, programs: DataFrame, program: str, game: str) -> DataFrame:
    """(dump, game): the first game with a program of the dump's name, or one that begins so if eight letters or more are left of it.

    Both kinds share the first eight letters, so it is an equi-join.
    """
    a = dumps.select(F.col(dump).alias("dump"), F.lower(dump).alias("_d")).withColumn("_k", F.substring("_d", 1, 8))
    b = programs.select(F.col(game).alias("game"), F.lower(program).alias("_p")).withColumn("_k", F.substring("_p", 1, 8))
    same = (F.col("_d") == F.col("_p")) | ((F.length("_d") >= 8) & F.startswith(F.col("_p"), F.col("_d")))
    return a.join(b, "_k").where(same).groupBy("dump").agg(F.min("game").alias("game"))


def report(categories: dict[str, DataFrame], name: str, size: str) -> DataFrame:
    """All categories' items (category, name, bytes, place), the largest first within each; an empty category has none."""
    rows = [d.select(F.lit(c).alias("category"), F.col(name).alias("name"), F.col(size).alias("bytes")) for c, d in categories.items()]
    largest = Window.partitionBy("category").orderBy(F.desc("bytes"), "name")
    return reduce(DataFrame.unionByName, rows).withColumn("place", F.row_number().over(largest))


#: Names of folders that scans leave out at any depth and at the top of a drive, and why; what a repository holds.
LEFT_OUT = {
    "Windows": ["$*"], "App data": [".*"], "Code": ["node_modules"],
    "Game library": ["steamapps", "SteamLibrary", "Epic Games", "GOG Games", "EA Games", "Origin Games", "Riot Games", "Ubisoft Game Launcher", "XboxGames", "ModifiableWindowsApps"],
    "Installed programs": ["WindowsApps"], "Photo app library": ["*.photoslibrary", "*.photolibrary", "*.aplibrary", "*.lrdata", "*.lrlibrary", "*.cocatalog"],
    "Video editor cache": ["Media Cache Files", "CacheClip"], "Account pictures": ["AccountPictures"],
}
LEFT_OUT_AT_TOP = {
    "Windows": ["Windows", "Windows.old", "Recovery", "PerfLogs", "System Volume Information", "Config.Msi", "ESD"],
    "Installed programs": ["Program Files", "Program Files (x86)", "Program Files (Arm)"], "App data": ["ProgramData", "OneDriveTemp", "MSOCache"],
    "Drivers": ["Intel", "AMD", "NVIDIA", "Drivers"], "Web server": ["inetpub"], "Developer tools": ["msys64", "cygwin", "cygwin64"],
}
REPOSITORY = [".git", ".hg", ".svn", "$tf", ".plastic", ".bzr", ".fslckout", "_FOSSIL_", ".jj", "_darcs", ".pijul", ".p4config"]


def exempt_reason(folder: Column, top: Column, hidden: Column, link: Column, holds: Column, readable: Column | None = None) -> Column:
    """Why a scan does not walk into a folder: the first rule that holds; null if it does.

    top: is it right below a drive; hidden: hidden and of the system; link: to another folder; holds: names of what lies in it.
    """
    name = names.file_name(folder)
    of = lambda patterns: reduce(Column.__or__, [names.wildcard(name, p) for p in patterns])
    rules = [(why, of(patterns)) for why, patterns in LEFT_OUT.items()] + [(why, top & of(patterns)) for why, patterns in LEFT_OUT_AT_TOP.items()]
    rules += [] if readable is None else [("Not readable", ~readable)]
    return first_reason([*rules, ("Windows", hidden), ("Link to another folder", link), ("Code repository", F.arrays_overlap(holds, F.array(*map(F.lit, REPOSITORY))))])


def cleanup_kind(kind: Column, of_game: Column, installed: Column, told_only: Column) -> Column:
    """The kind of automatic cleaning that takes an item; null for what it never takes: shader caches of installed games, paused downloads, mere hints."""
    game = F.when(kind.isin("orphan", "workshop"), "leftovers").when(kind.isin("cache", "download"), "caches").when(kind.isin("dump", "crash", "wer"), "dumps").when((kind == "shader") & ~installed, "shaders")
    other = F.when(kind == "projects", "buildOutputs").when(kind == "worktrees", "worktrees").when(kind.isin("temp", "dumps"), "temp").when(kind == "sysimage", "systemImages")
    return F.when(of_game & ~told_only, game).when(~of_game, other)
