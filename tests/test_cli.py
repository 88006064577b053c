"""Every command on a small folder."""

import numpy as np
import pytest

from tests.test_images import write_png
from vectrail import cli


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("cli")
    (where / "hands").mkdir()
    rng = np.random.default_rng(2)
    lines = ["id,age,gender,accessories,aspectOfHand,imageName"]
    for i in range(12):
        write_png(where / "hands" / f"h{i}.png", np.clip(rng.integers(0, 120, (40, 40, 3)) + 10 * i, 0, 255))
        if i < 9:
            lines.append(f"{i % 3},20,{'male' if i % 2 else 'female'},{i % 2},{'dorsal' if i % 2 else 'palmar'} {'left' if i % 3 else 'right'},h{i}.png")
    (where / "meta.csv").write_text("\n".join(lines) + "\n")
    cli.main(["extract", "--folder", str(where / "hands"), "--table", str(where / "table"), "--models", "CM,LBP", "--pattern", "*.png"], spark)
    return where


@pytest.mark.parametrize("command", [
    "similar --table T --image h0.png --model CM --m 3",
    "similar --table T --metadata M --image h0.png --model CM --label palmar --method pca --k 2",
    "latent --table T --model CM --method svd --k 2 --m 2",
    "infer --table T --metadata M --label dorsal --image h10.png --model CM",
    "infer --table T --metadata M --label dorsal --image h10.png --model CM --one-class",
    "subject --table T --metadata M --subject 1 --model CM",
    "subject-matrix --table T --metadata M --model CM",
    "metadata-latent --metadata M --k 2",
    "predict --table T --metadata M --model CM --classifier latent --k 2",
    "predict --table T --metadata M --model CM --classifier kmeans --k 2 --clusters 2",
    "predict --table T --metadata M --model CM --classifier DT --k 2",
    "predict --table T --metadata M --model CM --classifier SVM --k 2",
    "predict --table T --metadata M --model CM --classifier PPR",
    "dominant --table T --images h0.png,h3.png --model CM --k 3 --m 4",
    "index --table T --index I --model CM --layers 3 --hashes 2",
    "probe --table T --index I --image h0.png --model CM --m 6",
    "probe --table T --index I --image h0.png --model CM --m 6 --relevant h1.png --irrelevant h2.png",
    "split --folder F --metadata M --out O",
])
def test_commands(spark, place, command, capsys):
    names = {"T": "table", "M": "meta.csv", "I": "index", "F": "hands", "O": "out"}
    cli.main([str(place / names[w]) if w in names else w for w in command.split()], spark)
    assert "+--" in capsys.readouterr().out
