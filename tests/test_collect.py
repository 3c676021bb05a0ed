"""The whole tree collects: no test module or conftest may shadow another one's names."""
import os
import subprocess
import sys


def test_every_module_collects():
    here = os.path.dirname(os.path.abspath(__file__))
    done = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", here], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stdout[-2000:]
    assert "error" not in done.stdout.lower().splitlines()[-1]
