"""deckscope: document scoring and portfolio analytics as Spark DataFrame operators.

Entry points:

* ``deckscope.plans.document_plan.analyze(df)`` -- text -> sections -> scores ->
  category / summary / insight (narrow, one stage); ``results(df)`` for the
  result-table schema.
* ``deckscope.operators.portfolio`` / ``ranking`` / ``charts`` / ``ml`` -- the
  portfolio plans over a result table.
* ``deckscope.streaming.watch.start_scoring`` -- the same plan over new files.
* ``deckscope.session.get_spark`` -- a session with AQE on; fills unset settings only.
"""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
