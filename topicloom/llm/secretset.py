"""Labelled texts shipped for the secret scan: keys of several formats, and what only looks like one.

The set is bounded and the same at every call. Each text holds one payload; every candidate found in it has the text's label.
"""

from __future__ import annotations

import base64
import random
import string

WORDS = (
    "the and for with from that this have about other which their there would people could first water after where right think three small world place "
    "again point house found every great under never between national important different international development government understanding information "
    "communication responsibility administration representative approximately characteristic neighbourhood environment transformation"
).split()
HEX, LETTERS, ALNUM = "0123456789abcdef", string.ascii_letters, string.ascii_letters + string.digits
PUNCTUATED = ALNUM + "!#$%&*+-.?@^_~"
BASE32 = string.ascii_uppercase + "234567"


def texts(each: int = 30, seed: int = 4) -> list[tuple[str, float]]:
    """(text, label): label 1 for a secret, 0 for none."""
    rng = random.Random(seed)
    run = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    some = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    syllables = lambda n: "".join(rng.choice("bdfghklmnprstvw") + rng.choice("aeiou") + rng.choice(["", "", "n", "r", "s", "t"]) for _ in range(n))
    bits = lambda n: base64.b64encode(rng.randbytes(n)).decode()
    digits = lambda n: run(string.digits, n)
    uuid = lambda: "-".join(run(HEX, n) for n in (8, 4, 4, 4, 12))
    word = lambda: rng.choice(WORDS)
    keys = {
        "hex": lambda: run(HEX, rng.choice([18, 24, 32, 40, 64])), "upper hex": lambda: run(HEX, 32).upper(), "base64": lambda: bits(rng.choice([15, 24, 32, 48])),
        "url64": lambda: run(ALNUM + "-_", rng.choice([22, 32, 43])), "alnum": lambda: run(ALNUM, rng.choice([16, 20, 24, 32, 40])),
        "letters": lambda: run(LETTERS, rng.choice([16, 20, 24, 32])), "akia": lambda: "AKIA" + run(BASE32, 16), "akia letters": lambda: "AKIA" + run(string.ascii_uppercase, 16),
        "ghp": lambda: rng.choice(["ghp_", "gho_", "github_pat_"]) + run(ALNUM, 36), "sk": lambda: rng.choice(["sk_live_", "sk-", "pk_test_"]) + run(ALNUM, rng.choice([24, 48])),
        "xoxb": lambda: f"xoxb-{digits(11)}-{digits(12)}-{run(ALNUM, 24)}", "aiza": lambda: "AIza" + run(ALNUM + "-_", 35),
        "jwt": lambda: f"eyJ{run(ALNUM, 33)}.eyJ{run(ALNUM, 60)}.{run(ALNUM + '-_', 43)}",
    }
    passwords = {
        "punctuated": lambda: run(PUNCTUATED, rng.choice([8, 10, 12, 16, 20])), "short": lambda: run(ALNUM, rng.choice([6, 8, 10, 12])),
        "word and digits": lambda: rng.choice([str.lower, str.capitalize])(word()) + digits(rng.choice([2, 4])) + rng.choice(["", "!", "#", "$"]),
        "changed word": lambda: word().capitalize().replace("o", "0").replace("a", "4") + rng.choice("&!?#@") + digits(rng.choice([1, 2, 3])),
    }
    names = ["token", "secret", "password", "passwd", "pwd", "api_key", "API_KEY", "apikey", "auth_token", "client_secret", "access_key", "private_key", "AWS_SECRET_ACCESS_KEY", "credential"]
    given = ['{n} = "{k}"', "{n}={k}", "{n}: {k}", "{n} = '{k}'", '"{n}": "{k}",', "export {n}={k}"]
    bare = ["{k}", "use {k} here", "Authorization: Bearer {k}", "({k})", "'{k}',"]
    out = []
    for of, frames in ((keys, given + bare), (passwords, given)):
        for make in of.values():
            out += [(f"{some(4)} {rng.choice(frames).format(n=rng.choice(names), k=make())} {some(4)}", 1.0) for _ in range(each)]
    plain = {
        "number": lambda: rng.choice(["", "order ", "card ", "id ", "id: ", "phone = "]) + digits(rng.choice([16, 18, 20])),
        "uuid": lambda: rng.choice(["", "uuid ", "id=", "request "]) + uuid(),
        "digest": lambda: rng.choice(["sha256:", "commit ", "md5 = ", "checksum: ", "digest ", "etag: ", "hash "]) + run(HEX, rng.choice([32, 40, 64])),
        "path": lambda: "/" + "/".join(rng.choice([word, lambda: word() + digits(2)])() for _ in range(rng.choice([3, 4, 5]))) + rng.choice(["", ".py", ".html"]),
        "unknown path": lambda: "/usr/" + "/".join(syllables(3) + rng.choice(["", digits(1)]) for _ in range(3)),
        "address": lambda: f"https://{word()}.org/{word()}/{run(HEX, rng.choice([8, 16, 32]))}?id={digits(18)}",
        "slug": lambda: "-".join([*(word() for _ in range(4)), digits(rng.choice([1, 4]))]),
        "words joined": lambda: "-".join(word() for _ in range(4)), "snake": lambda: "_".join(word() for _ in range(4)) + rng.choice(["", "_v2", "2"]),
        "camel": lambda: word() + "".join(word().capitalize() for _ in range(4)) + rng.choice(["", "2", "V1"]),
        "long word": lambda: rng.choice([w for w in WORDS if len(w) > 12]) + rng.choice(["", "communication", "s"]),
        "unknown long word": lambda: rng.choice([str, str.capitalize])(syllables(rng.choice([6, 7, 8, 9]))), "unknown words": lambda: "-".join(syllables(3) for _ in range(3)),
        "time": lambda: f"20{digits(2)}-0{rng.randint(1, 9)}-1{digits(1)}T1{digits(1)}-{digits(2)}-{digits(2)}-{digits(6)}", "line": lambda: rng.choice("-_/=+") * rng.choice([16, 24, 40]),
        "author": lambda: f"{rng.choice(['Author', 'author', 'Authority'])}: {rng.choice([lambda: word().capitalize(), lambda: syllables(3).capitalize()])()}",
        "secret of prose": lambda: f"{rng.choice(['the secret', 'Password', 'password', 'access', 'private', 'token', 'Tokens'])}: {rng.choice([word, lambda: syllables(2)])()}",
        "quoted prose": lambda: f"{rng.choice(['secret', 'Access', 'author'])}: \"{some(6)}\"",
        "placeholder": lambda: f"{rng.choice(names)}{rng.choice(['=', ': ', ' = '])}"
        + rng.choice(["null", "None", "true", "false", "********", "xxxxxxxx", "<token>", "${TOKEN}", "$PASSWORD", "os.environ", "...", "getpass()", "self.token", "string", "required"]),
    }
    for make in plain.values():
        out += [(f"{some(4)} {make()} {some(4)}", 0.0) for _ in range(each)]
    return out
