import pytest

from tastemap.operators import release
from tastemap.plans import privacy


def test_captions_without_a_user(spark, tmp_path):
    """They reach the topics as the SQL has them, and stop a release."""
    rows = [(1, 0, "a"), (None, 1, "b")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    captions = privacy.release_captions(spark, str(tmp_path))
    mapping = spark.createDataFrame([("src_1", "participant_002")], "source_id string, public_id string")
    assert captions.count() == 2
    assert release.candidate_captions(captions.filter("user_id is not null"), mapping).count() == 1
    with pytest.raises(Exception, match="Caption without a user"):
        release.candidate_captions(captions, mapping).collect()
