import gzip
import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logsluice.session import session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session(
        "tests",
        "local[8]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="4",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


def record(event_id, time="2024-01-29T12:00:00Z", **more):
    """One audit record; keyword arguments replace or add keys, ``None`` stays a JSON null."""
    base = {
        "eventVersion": "1.08",
        "userIdentity": {
            "type": "AssumedRole",
            "principalId": "P1",
            "arn": "arn:role/x",
            "accountId": "012345678901",
            "accessKeyId": "K1",
            "userName": "ada",
            "sessionContext": {
                "attributes": {"mfaAuthenticated": "false", "creationDate": "2024-01-29T08:00:00Z"},
                "sessionIssuer": {
                    "type": "Role",
                    "principalId": "P0",
                    "arn": "arn:role/y",
                    "accountId": "012345678901",
                    "userName": "issuer",
                    "webIdFederationData": {"provider": "idp"},
                },
            },
        },
        "eventTime": time,
        "eventSource": "store.example.com",
        "eventName": "GetObject",
        "awsRegion": "eu-west-1",
        "sourceIPAddress": "10.0.0.1",
        "userAgent": "cli",
        "requestID": f"r{event_id}",
        "eventID": event_id,
        "eventType": "ApiCall",
        "recipientAccountId": "012345678901",
        "requestParameters": {"bucket": "b", "n": 1},
        "readOnly": True,
        "managementEvent": "false",
        "resources": [{"arn": "arn:b", "accountId": "012345678901", "type": "Bucket"}],
        "sharedEventID": f"s{event_id}",
    }
    return {**base, **more}


def write_log(folder, name, records, key="Records"):
    """One gzip envelope file below ``folder``."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{name}.json.gz")
    with gzip.open(path, "wt") as f:
        json.dump({key: records}, f)
    return path


@pytest.fixture()
def tree(tmp_path):
    """Two accounts, two delivery days, digests, and events either side of midnight."""
    root = tmp_path / "logs"
    first = root / "012345678901/CloudTrail/eu-west-1"
    write_log(
        first / "2024/01/30",
        "a",
        [
            record("e1", "2024-01-29T23:59:30Z"),
            record("e2", "2024-01-30T00:00:30Z", readOnly="junk", requestParameters=None),
        ],
    )
    write_log(
        first / "2024/01/29",
        "b",
        [
            record("e3", "not a time", readOnly="true", vpcEndpointId=" \t\r\n "),
            record("e4", "2024-01-29T05:00:00Z", eventSource=None, vpcEndpointId="vpce-1"),
        ],
    )
    write_log(first / "2024/01/29", "empty", [])
    write_log(
        root / "111111111111/CloudTrail/us-east-1/2024/01/30",
        "c",
        [record("e5", "2024-01-30T10:00:00Z", recipientAccountId="111111111111", awsRegion="us-east-1")],
    )
    write_log(
        root / "012345678901/CloudTrail-Digest/eu-west-1/2024/01/30", "d", [record("digest")]
    )
    return str(root)
