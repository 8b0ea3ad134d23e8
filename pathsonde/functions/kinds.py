"""What a file is, by its extension, its name and its mode."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds in the order of their numbers.
KINDS = ("file", "folder", "code", "image", "archive", "doc", "exec", "media", "audio", "video", "build", "data", "config", "font")
NUMBER = {k: n for n, k in enumerate(KINDS)}

#: Words of ``kind:`` and the kinds they stand for.
KIND_WORDS = {
    "dir folder klasor klasör": ("folder",), "code source kod kaynak": ("code",), "image img pic gorsel görsel resim": ("image",),
    "archive arsiv arşiv zip": ("archive",), "doc document belge": ("doc",), "exec exe bin executable calistirilabilir çalıştırılabilir": ("exec",),
    "audio ses muzik müzik": ("audio",), "video film": ("video",), "media medya": ("audio", "video", "media"), "build derleme cikti çıktı": ("build",),
    "data veri": ("data",), "config conf settings ayar yapilandirma yapılandırma": ("config",), "font yazitipi yazıtipi": ("font",),
    "file dosya": ("file",), "text metin": ("code", "doc", "data", "config"),
}

#: The extensions that mean one kind; results depend on each of them.
EXTENSIONS = {
    "code": "asm awk bash c cc cjs clj cljs cmake comp cpp cr cs css cxx dart el erl ex exs fish frag fs glsl gn gni go gradle groovy h hcl hlsl hpp hrl hs hxx idl ipynb java jl js jsx kt kts less lua m make metal mjs mk ml mli mm mts nim nix php pl pm proto ps1 py pyi pyx qml r rb rs s sass scala scss sh slint sol sql storyboard svelte swift tf thrift ts tsx ui vb vert vim vue wat wgsl wit zig zsh",
    "image": "afdesign afphoto avif bmp cr2 dng gif heic ico jpeg jpg nef png psd raw svg tif tiff webp xcf",
    "archive": "7z aar apk bz2 cab crate deb dmg gem gz img iso jar lz4 pkg qcow2 rar rpm squashfs tar tgz vdi vhd vhdx vmdk whl xz zip zst",
    "doc": "1 adoc asciidoc ass azw3 djvu doc docx eml epub htm html mbox md mobi msg odp ods odt org pdf ppt pptx rst rtf srt sub tex txt vtt xhtml xls xlsx",
    "exec": "appimage bat cmd com dll dylib exe msi run so wasm",
    "audio": "aac aif aiff flac m3u m3u8 m4a mid midi mp3 ogg opus pls wav wma",
    "video": "3gp avi flv m4v mkv mov mp4 mpeg mpg ogv vob webm wmv",
    "build": "a bc bin class d dex digest dill dwo gcda gch gcno ilk lib map mo o pch pdb pyc qm rlib rmeta timestamp",
    "data": "arb avro csv dat db db3 dtd gguf h5 json jsonl lock log npy npz onnx pack parquet pickle pkl po pot pt pth resx safetensors sqlite sqlite3 tsv xliff xml xsd",
    "config": "cer cfg conf crt der env ini jks keystore pbxproj pem pfx plist pom properties toml xcconfig yaml yml",
    "font": "eot fon otf pcf ttc ttf woff woff2",
}
#: Names without an extension, whole and by how they begin.
NAMES = {
    "config": ".bash_profile .bashrc .dockerignore .editorconfig .env .gitattributes .gitconfig .gitignore .gitmodules .npmignore .npmrc .profile .vimrc .zshrc",
    "build": ".cargo-ok", "doc": "authors contributors install news notice todo", "code": "brewfile gemfile justfile pkgbuild procfile rakefile vagrantfile",
}
BEGINNINGS = (("changelog", "doc"), ("changes", "doc"), ("copying", "doc"), ("dockerfile", "code"), ("licence", "doc"), ("license", "doc"), ("makefile", "code"), ("readme", "doc"))
#: Pages that documentation tools write, beside those with a dot in their stem.
GENERATED = "allclasses allclasses-frame allclasses-index allclasses-noframe allpackages-index constant-values deprecated-list element-list help-doc index-all member-search-index overview-frame overview-summary overview-tree package-frame package-search-index package-summary package-tree package-use serialized-form type-search-index".split()
RUNS = "desktop sh bash zsh ksh fish ps1 scr lnk vbs wsf jar".split()


@functools.lru_cache(maxsize=1)
def extensions() -> dict[str, str]:
    """Kind of each extension."""
    return {e: k for k, words in EXTENSIONS.items() for e in words.split()}


def kind_words(word: str) -> tuple[str, ...] | None:
    return next((kinds for words, kinds in KIND_WORDS.items() if word in words.split()), None)


def raw_extension(name: Column) -> Column:
    """After the last dot, if something stands before it and it has 1 to 12 bytes."""
    ext = F.substring_index(name, ".", -1)
    fits = name.contains(".") & (F.octet_length(ext) <= 12) & (F.char_length(name) > F.char_length(ext) + 1)
    return F.when(fits, ext).otherwise("")


def extension_table(spark: SparkSession) -> DataFrame:
    """``(ext_key, ext_kind)``: a few hundred rows that are part of the plan."""
    rows = ", ".join(f"('{e}', {NUMBER[k]})" for e, k in sorted(extensions().items()))
    return spark.sql(f"SELECT ext_key, ext_kind FROM VALUES {rows} AS t(ext_key, ext_kind)")


def with_kind(rows: DataFrame, ext: str) -> DataFrame:
    """Add ``kind``, a number: by folder, extension (the column ``ext``, in lower case with marks), name or mode, in this order."""
    out = rows.join(F.broadcast(extension_table(rows.sparkSession)), F.col(ext) == F.col("ext_key"), "left")  # a few hundred rows
    name, folded = F.col(ext), F.col("cased")
    stem = F.substr(folded, F.lit(1), F.char_length(folded) - F.char_length(name) - 1)
    generated = name.isin("html", "htm") & (stem.contains(".") | stem.isin(*GENERATED))
    by_name = F.lit(None).cast("int")
    for start, kind in reversed(BEGINNINGS):
        by_name = F.when(folded.startswith(start), NUMBER[kind]).otherwise(by_name)
    for kind, words in NAMES.items():
        by_name = F.when(folded.isin(*words.split()), NUMBER[kind]).otherwise(by_name)
    runs = F.when(F.col("mode").bitwiseAND(F.lit(0o111)) != 0, NUMBER["exec"]).otherwise(NUMBER["file"])
    found = F.when(name == "", by_name).when(generated, NUMBER["build"]).otherwise(F.col("ext_kind"))
    kind = F.when(F.col("is_dir"), NUMBER["folder"]).otherwise(F.coalesce(found, runs)).cast("int")
    return out.withColumn("kind", kind).drop("ext_key", "ext_kind")


def kind_token(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), number + 1)


def runs_when_opened(kind: Column, ext: Column) -> Column:
    return (kind == NUMBER["exec"]) | ext.isin(*RUNS)


def mode_string(is_dir: Column, mode: Column) -> Column:
    """As ``ls`` writes it: type, then rwx thrice with s, S, t and T."""
    bit = lambda m: mode.bitwiseAND(F.lit(m)) != 0
    node = mode.bitwiseAND(F.lit(0o170000))
    head = F.when(node == 0o120000, "l").when(node == 0o140000, "s").when(node == 0o010000, "p").when(node == 0o060000, "b").when(node == 0o020000, "c").when(is_dir | (node == 0o040000), "d").otherwise("-")
    parts = [head]
    for shift, special, yes, no in ((6, 0o4000, "s", "S"), (3, 0o2000, "s", "S"), (0, 0o1000, "t", "T")):
        x = bit(1 << shift)
        parts += [F.when(bit(4 << shift), "r").otherwise("-"), F.when(bit(2 << shift), "w").otherwise("-")]
        parts.append(F.when(bit(special) & x, yes).when(bit(special), no).when(x, "x").otherwise("-"))
    return F.concat(*parts)
