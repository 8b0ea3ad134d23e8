"""Volumes from the text of a mount table."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathsonde.functions.paths import under_or_self

#: File systems that hold no one's files, those of other machines, those of discs, and where a system mounts for itself.
VIRTUAL = "proc sysfs devtmpfs devpts tmpfs ramfs securityfs cgroup cgroup2 pstore efivarfs bpf tracefs debugfs configfs fusectl mqueue hugetlbfs autofs binfmt_misc rpc_pipefs nsfs overlay squashfs erofs fuse.portal fuse.gvfsd-fuse fuse.xdg-document-portal fuse.lxcfs fuse.snapfuse zram".split()
NETWORK = "nfs nfs4 cifs smb3 smbfs 9p fuse.sshfs fuse.rclone davfs ceph glusterfs fuse.glusterfs afs".split()
DISCS = ("iso9660", "udf")
OWN_PLACES = ("/proc", "/sys", "/dev", "/run", "/boot", "/efi", "/snap", "/tmp", "/var/lib/docker", "/var/lib/containers", "/var/lib/snapd")
PLUGGED_IN = ("/run/media", "/media")


def mounts(spark: SparkSession, path: str = "file:///proc/self/mountinfo") -> DataFrame:
    """``(device, root, mount, options, fs, origin, noatime)`` of each line; octal escapes of blanks are undone."""
    halves = F.split("value", " - ", 2)
    left, right = F.split(halves[0], " "), F.split(halves[1], " ")
    plain = lambda c: F.replace(F.replace(c, F.lit("\\040"), F.lit(" ")), F.lit("\\011"), F.lit("\t"))
    return spark.read.text(path).filter(F.size(halves) == 2).select(
        left[2].alias("device"), plain(left[3]).alias("root"), plain(left[4]).alias("mount"), left[5].alias("options"), right[0].alias("fs"), plain(right[1]).alias("origin"), F.array_contains(F.split(left[5], ","), "noatime").alias("noatime")
    )


def _in(places: tuple[str, ...]):
    return reduce(or_, [under_or_self(F.col("mount"), p) for p in places])


def volumes(mounted: DataFrame) -> DataFrame:
    """One volume per device that holds files: ``(device, mount, fs, kind, roots)``, the shortest mount point standing for it.

    ``roots`` are its mount points that do not lie in one another. Mounts that show a part of what another one of the
    device shows are left out. A volume is the system's if it is mounted at the top, wherever else it may be.
    """
    real = mounted.filter(~F.col("fs").isin(*VIRTUAL) & (~_in(OWN_PLACES) | _in(PLUGGED_IN[:1])))
    kind = F.when(F.col("mount") == "/", "system").when(F.col("fs").isin(*NETWORK), "network").when(_in(PLUGGED_IN) | F.col("fs").isin(*DISCS), "removable").otherwise("internal")
    one = real.groupBy("device").agg(F.collect_set(F.struct(F.char_length("mount").alias("n"), "mount", "root", "fs", kind.alias("kind"))).alias("all"))
    inside = lambda x, o: (x == o) | x.startswith(F.concat(F.rtrim(o, F.lit("/")), F.lit("/")))
    whole = F.filter("all", lambda x: ~F.exists("all", lambda o: inside(x["root"], o["root"]) & (x["root"] != o["root"])))
    kept = one.select("device", F.array_sort(whole).alias("m"))
    roots = F.filter("m", lambda x: ~F.exists("m", lambda o: inside(x["mount"], o["mount"]) & (x["mount"] != o["mount"])))
    is_system = F.exists("m", lambda x: x["kind"] == "system")
    return kept.select("device", F.col("m")[0]["mount"].alias("mount"), F.col("m")[0]["fs"].alias("fs"), F.when(is_system, "system").otherwise(F.col("m")[0]["kind"]).alias("kind"), F.transform(roots, lambda x: x["mount"]).alias("roots"))
