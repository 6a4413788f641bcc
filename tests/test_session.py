import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import sys
sys.path.insert(0, {root!r})
from leafmill.session import cut, get_session, put_file, shared_dir, ship, written
spark = get_session("t", "local[1]", **{{"spark.checkpoint.dir": "file://" + {folder!r}}})
assert shared_dir(spark) == "file://" + {folder!r}
path, seen = put_file(spark, "a.bin", b"xyz")
assert seen and open(path, "rb").read() == b"xyz" and path.startswith({folder!r})
assert cut(spark.range(3)).count() == 3 and written(spark.range(4), "rows").count() == 4
ship(spark)
ship(spark)
import os
kinds = {{name.split("-")[0] for name in os.listdir({folder!r})}}
assert {{"rows", "leafmill"}} <= kinds, kinds
def name(parts):
    import leafmill.functions.stem as stem
    for part in parts:
        yield part.assign(id=[len(stem.english("running"))] * len(part))
assert spark.range(2).mapInPandas(name, "id long").first()[0] == 3
"""


def test_shared_folder_is_the_session_s(tmp_path):
    """All that is written goes to the folder that the session names, and workers find the package from anywhere."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", CODE.format(root=ROOT, folder=str(tmp_path / "shared"))], check=True, cwd="/", env=env, timeout=120)
