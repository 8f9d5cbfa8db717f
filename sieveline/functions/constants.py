"""Word lists and weights that results depend on. Fixed values, in natural order."""

from __future__ import annotations

import unicodedata

#: Words that are never indexed.
STOPWORDS = [
    "the", "and", "for", "with", "that", "this", "from", "into", "when", "where", "what", "which", "should",
    "would", "could", "please", "make", "just", "also", "have", "been", "will", "your", "our", "are", "was", "were",
    "can", "need", "fix", "update", "change", "add", "remove", "create", "implement", "refactor", "code", "file",
    "function", "class", "module", "project", "using", "use",
]

#: Words that are dropped from a task.
TASK_STOPWORDS = [
    "the", "and", "for", "with", "that", "this", "from", "into", "please", "just", "also", "have", "been", "will",
    "your", "our", "are", "was", "were", "ve", "ile", "icin", "bir", "bu", "et", "kontrol", "durumunu", "raporla",
]

#: A word of a task and what it stands for besides itself.
SYNONYMS = {
    "sifre": "password auth token secret credential",
    "parola": "password auth token",
    "eposta": "email mail smtp",
    "mail": "email eposta",
    "duzenle": "update edit patch modify",
    "guncelle": "update edit patch modify",
    "sil": "delete remove clear",
    "kaldir": "delete remove clear",
    "ekle": "add insert append create",
    "kullanici": "user account profile",
    "sirala": "sort order arrange",
    "siralama": "sort order arrange",
    "siralamasini": "sort order arrange sirala",
    "hata": "error exception fault bug",
    "test": "test spec check",
    "entegrasyon": "integration test",
    "regresyon": "regression test",
    "linter": "lint eslint biome",
    "linting": "lint eslint biome",
    "imports": "import",
    "ordering": "order sort",
    "uri": "url resource read",
    "session": "transport http client header",
    "declaration": "dts types build config",
    "bundle": "external tsdown config",
    "oom": "memory bundle dts config",
    "serialize": "encode document codec",
    "deserialize": "decode document codec",
    "hit": "serve read write",
    "aynalama": "mirror mirroring",
}

#: Prefixes that act like a word of SYNONYMS, tried in this order after the exact words.
SYNONYM_PREFIXES = (
    ("test", "test spec check"),
    ("entegrasyon", "integration test"),
    ("regresyon", "regression test"),
    ("document", "document"),
    ("aynalama", "mirror mirroring"),
)

#: Turkish stems and English identifiers; the first stem that fits wins. Stems below four letters fit whole words only.
STEMS = (
    ("bildirim", "notification notify alert"),
    ("dogrula", "verify validate auth factor"),
    ("guncelle", "update patch"),
    ("kullanici", "user account member"),
    ("veritabani", "database db store"),
    ("yetkilendir", "auth permission role"),
    ("gonderil", "send request"),
    ("gonderim", "send request"),
    ("gonderi", "post entry"),
    ("gonder", "send request"),
    ("cozum", "resolve parse match"),
    ("yanit", "response"),
    ("baglan", "connect connection socket"),
    ("katil", "join enter participant"),
    ("oturum", "session auth login"),
    ("parola", "password credential"),
    ("profil", "profile account"),
    ("sifre", "password credential"),
    ("yukle", "upload"),
    ("ayar", "setting preference"),
    ("canli", "live stream realtime"),
    ("hafiza", "memory cache"),
    ("istemci", "client"),
    ("kaydet", "save persist store"),
    ("mesaj", "message chat"),
    ("sunucu", "server host"),
    ("yayin", "stream broadcast live publish"),
    ("yorum", "comment"),
    ("arama", "search query find"),
    ("bellek", "memory cache"),
    ("dosya", "file"),
    ("gorsel", "image picture media"),
    ("indir", "download fetch"),
    ("istek", "request"),
    ("giris", "login signin auth entry"),
    ("cikis", "logout signout exit"),
    ("resim", "image picture"),
    ("sayfa", "page screen view"),
    ("sesli", "voice audio"),
    ("takip", "follow subscribe watch"),
    ("yetki", "permission role auth access"),
    ("adim", "step factor stage"),
    ("hata", "error failure exception"),
    ("liste", "list collection"),
    ("odeme", "payment billing checkout"),
    ("sorgu", "query"),
    ("tema", "theme style"),
    ("oda", "room channel"),
    ("ses", "voice audio sound"),
    ("sil", "delete remove destroy"),
)
#: English words that only look as if they began with a stem.
STEM_COLLISIONS = ["listen", "listener", "listeners", "listening", "listed", "listing", "indirect", "indirectly", "indirection"]
SHORTEST_PREFIX_STEM = 4

#: Function words by which a Turkish task without diacritics is told.
TURKISH_WORDS = [
    "ve", "ile", "icin", "bir", "bu", "su", "ama", "gibi", "olarak", "sonra", "once", "kadar", "daha", "cok",
    "yerine", "gorev", "kriteri", "kriter", "duzelt", "ekle", "sil", "kaldir", "degistir", "olmali", "gecmeli",
    "testi", "testleri", "hatasi", "dosya", "dosyalar", "sirasinda", "engelle", "koru", "yap", "yaz", "davranisi",
    "davranisini", "geriye", "uyumlulugu", "basari", "gerek", "gerekiyor", "calismiyor", "calisiyor", "neden",
    "nasil", "sadece", "yalniz", "tum", "her", "icinde", "uzerinde", "arasinda", "olsun", "olmasin", "dondur",
]

TEST_WORDS = ["test", "spec", "check", "integration", "regression"]
ORDER_WORDS = ["sort", "order", "arrange", "lint"]
CONFIG_WORDS = [
    "lint", "eslint", "biome", "test", "build", "typecheck", "dependency", "script", "import", "order", "sort",
    "config", "package",
]
RUNTIME_WORDS = ["server", "client", "handler", "request", "runtime"]
SAMPLE_WORDS = ["benchmark", "fixture", "demo", "example"]

#: Quality criteria: name and the task words that call for it, in order; the first three (with the base) count.
CRITERIA = (
    ("isolation", ["integration", "workspace", "process", "worker", "temp", "cleanup"]),
    ("contract", ["public", "api", "type", "cache", "serialize", "document", "codec"]),
    ("build", ["declaration", "dts", "bundle", "external", "config", "oom"]),
    ("lifecycle", ["transport", "session", "stream", "http"]),
    ("header", ["header"]),
    ("error", ["error", "exception", "invalid", "uri", "url"]),
)
AUTH_PATTERN = r"(^|[^a-z0-9_])(auth|401|refresh|retry|token)([^a-z0-9_]|$)"

SOURCE_EXTENSIONS = ["ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs"]
SKIPPED_DIRECTORIES = [
    "node_modules", ".git", "dist", "out", "target", "coverage", ".turbo", "build", ".next", ".cache", "vendor",
    "tmp", "temp", ".venv", "venv", ".tsbuildinfo", ".nuxt", ".svelte-kit", ".output",
]

#: BM25 and field weights.
K1, B = 1.4, 0.75
FIELD_WEIGHTS = {"name": 4.0, "path": 2.2, "signature": 1.2, "body": 0.8}
BODY_CHARS, TEST_BODY_CHARS, BAG_BODY_TOKENS = 4000, 8000, 80
#: Capsule levels: direct symbols, neighbours, tokens.
LEVELS = ((0, 1, 0, 200), (1, 3, 1, 250), (2, 6, 2, 400), (3, 8, 3, 600))


def _folding() -> tuple[str, str]:
    """Letters with diacritics and the ASCII letters they fold to, by the Unicode decomposition."""
    source, target = [], []
    for code in range(0xC0, 0x250):
        char = chr(code)
        base = unicodedata.normalize("NFKD", char)[0]
        if base != char and base.isascii() and base.isalpha():
            source.append(char)
            target.append(base)
    for char, base in (("ı", "i"), ("İ", "i")):
        if char in source:
            target[source.index(char)] = base
        else:
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _folding()
