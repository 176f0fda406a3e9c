"""Secrets and look-alikes planted in real texts, by forms that the generator of findings does not have."""

import random
import string
import uuid

HEX, ALNUM, B64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"


def _run(rng, alphabet, n):
    while True:
        out = "".join(rng.choice(alphabet) for _ in range(n))
        if any(c.isdigit() for c in out):
            return out


def planted(texts, seed=1):
    """[(doc_id, text, candidate, label)]: one secret or look-alike in the middle of each text."""
    rng, out = random.Random(seed), []
    secrets = [
        lambda r: ("export STRIPE_SECRET=sk_live_{}", _run(r, ALNUM, 24), "sk_live_"), lambda r: ("curl -H 'X-Api-Key: {}' https://svc.example.net", _run(r, ALNUM, 32), ""), lambda r: ('{{"client_secret": "{}", "retries": 3}}', _run(r, B64, 40), ""),
        lambda r: ("postgres://admin:{}@db.internal.example.net:5432/app", _run(r, ALNUM, 18), ""), lambda r: ("<add key=\"SmtpPassword\" value=\"{}\" />", _run(r, ALNUM, 16), ""), lambda r: ("the root password was changed to {} last night", _run(r, ALNUM, 14), ""),
        lambda r: ("AWS_SECRET_ACCESS_KEY: {}", _run(r, B64, 40), ""), lambda r: ("my ssh passphrase is {} please delete", _run(r, ALNUM, 20), ""), lambda r: ("x-auth-token {} expires soon", _run(r, HEX, 40), ""),
    ]
    others = [
        lambda r: ("Merge pull request, see {} for the change", _run(r, HEX, 40), ""), lambda r: ("file backup.tar.gz SHA256 {}", _run(r, HEX, 64), ""), lambda r: ("src=\"data:image/png;base64,{}\"", _run(r, B64, 60), ""), lambda r: ("ticket number {} was closed", "TICKET-" + str(r.randrange(10**9)).zfill(9), ""),
        lambda r: ("https://news.example.org/2024/05/{}", "-".join(r.choice(("city", "opens", "new", "school", "after", "long", "work")) for _ in range(5)) + "-" + str(r.randrange(10**6)), ""), lambda r: ("session {} timed out", str(uuid.UUID(int=r.getrandbits(128))), ""), lambda r: ("serial no. {} on the back", "SN" + str(r.randrange(10**14)).zfill(14), ""),
        lambda r: ("call {} between nine and five", "0049-" + str(r.randrange(10**9)).zfill(9), ""), lambda r: ("docker pull registry/app@sha256:{}", _run(r, HEX, 64), ""), lambda r: ("the identifier {} of the record", _run(r, HEX, 24), ""),
    ]
    for n, (doc_id, text) in enumerate(texts):
        label = n % 2
        form, value, lead = (secrets if label else others)[n // 2 % len(secrets if label else others)](rng)
        words = text.split(" ")
        at = rng.randrange(len(words) + 1)
        out.append((doc_id, " ".join([*words[:at], form.format(value), *words[at:]]), lead + value, label))
    return out
