"""Stream-back: the result of a batch script becomes records of a topic."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from topicloom.functions.types import struct_to_avro
from topicloom.operators.aggregates import FAILED, FINISHED, RUNNING, UNASSIGNED
from topicloom.operators.scripts import run_script
from topicloom.session import fresh_dir
from topicloom.sources.files import file_to_topic
from topicloom.sources.topics import Topics
from topicloom.streaming.runs import drain


@dataclass
class StreamBack:
    """Progress of one stream-back: UNASSIGNED, RUNNING, then FINISHED or FAILED."""

    topics: Topics
    topic: str
    states: list[str] = field(default_factory=lambda: [UNASSIGNED])
    schema_json: str = ""

    @property
    def state(self) -> str:
        return self.states[-1]

    def run(self, script: str) -> DataFrame:
        """Run the script once, write its result as JSON files and stream those to the topic."""
        spark = self.topics.spark
        result = run_script(spark, script)
        files = fresh_dir(spark, "streamback")
        try:
            result.write.json(files)
            self.schema_json = struct_to_avro(result.schema, self.topic, "writeback")
            self.states.append(RUNNING)
            drain(file_to_topic(self.topics, files, "*.json", self.topic, result.schema,
                                fresh_dir(spark, "checkpoint")))
        except Exception:
            self.states.append(FAILED)
            raise
        self.states.append(FINISHED)
        return self.topics.read(self.topic, result.schema)
