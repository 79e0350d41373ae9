"""Lookup tables and word lists of the file and dependency operators."""

# They decide results, so they are given as they are.
LANGUAGE_BY_EXTENSION = {
    ".py": "python", ".pyx": "python", ".pyi": "python",
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".gs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".cs": "csharp", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php",
    ".cpp": "cpp", ".cxx": "cpp", ".cc": "cpp", ".c": "cpp", ".h": "cpp", ".hpp": "cpp", ".swift": "swift", ".kt": "kotlin", ".scala": "scala",
    ".hs": "haskell", ".ml": "ocaml", ".ex": "elixir", ".erl": "erlang", ".clj": "clojure", ".lua": "lua", ".pl": "perl", ".r": "r", ".jl": "julia",
    ".dart": "dart", ".zig": "zig", ".nim": "nim", ".crystal": "crystal",
}

DISPLAY_BY_EXTENSION = {
    ".js": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript", ".jsx": "JavaScript (React)", ".ts": "TypeScript", ".tsx": "TypeScript (React)",
    ".vue": "Vue.js", ".svelte": "Svelte", ".astro": "Astro", ".html": "HTML", ".htm": "HTML", ".css": "CSS", ".scss": "SASS", ".sass": "SASS", ".less": "LESS", ".styl": "Stylus",
    ".py": "Python", ".pyx": "Cython", ".pyi": "Python Interface", ".java": "Java", ".kt": "Kotlin", ".scala": "Scala", ".groovy": "Groovy", ".cs": "C#", ".vb": "Visual Basic .NET", ".fs": "F#",
    ".c": "C", ".cpp": "C++", ".cxx": "C++", ".cc": "C++", ".h": "C/C++ Header", ".rs": "Rust", ".go": "Go", ".swift": "Swift", ".rb": "Ruby", ".php": "PHP", ".pl": "Perl", ".lua": "Lua",
    ".hs": "Haskell", ".ml": "OCaml", ".elm": "Elm", ".ex": "Elixir", ".erl": "Erlang", ".clj": "Clojure", ".scm": "Scheme", ".lisp": "Common Lisp",
    ".r": "R", ".jl": "Julia", ".m": "MATLAB", ".ipynb": "Jupyter Notebook", ".dart": "Dart", ".gs": "Google Apps Script", ".zig": "Zig", ".nim": "Nim", ".crystal": "Crystal", ".d": "D",
    ".md": "Markdown", ".rst": "reStructuredText", ".tex": "LaTeX", ".json": "JSON", ".yaml": "YAML", ".yml": "YAML", ".toml": "TOML", ".xml": "XML", ".ini": "INI", ".cfg": "Config",
    ".sql": "SQL", ".graphql": "GraphQL", ".gql": "GraphQL", ".sh": "Shell Script", ".bash": "Bash", ".zsh": "Zsh", ".fish": "Fish", ".ps1": "PowerShell", ".bat": "Batch", ".cmd": "Command Script",
    ".tf": "Terraform", ".hcl": "HCL", ".dockerfile": "Dockerfile", ".gd": "GDScript", ".hlsl": "HLSL", ".glsl": "GLSL", ".shader": "Shader", ".sol": "Solidity", ".move": "Move", ".cairo": "Cairo",
    ".pas": "Pascal", ".cob": "COBOL", ".for": "FORTRAN", ".asm": "Assembly", "no_extension": "No Extension",
}

CATEGORY_BY_EXTENSION = {
    ".py": "backend", ".rb": "backend", ".java": "backend", ".go": "backend", ".php": "backend", ".cs": "backend", ".cpp": "backend", ".c": "backend", ".rs": "backend", ".kt": "backend", ".js": "frontend", ".ts": "frontend", ".jsx": "frontend", ".tsx": "frontend", ".html": "frontend", ".htm": "frontend", ".vue": "frontend", ".svelte": "frontend", ".css": "styling", ".scss": "styling", ".sass": "styling", ".less": "styling", ".styl": "styling", ".json": "config", ".yaml": "config", ".yml": "config", ".toml": "config", ".ini": "config", ".conf": "config", ".env": "config", ".properties": "config", ".md": "docs", ".rst": "docs", ".txt": "docs", ".adoc": "docs", ".sql": "database", ".graphql": "database", ".gql": "database", ".tf": "infrastructure", ".hcl": "infrastructure", ".sh": "infrastructure", ".bash": "infrastructure", ".ps1": "infrastructure", ".bat": "infrastructure",
}
CATEGORY_BY_NAME = {
    "dockerfile": "infrastructure", "dockerfile.dev": "infrastructure", "dockerfile.prod": "infrastructure", "requirements.txt": "build", "package.json": "build", "package-lock.json": "build", "yarn.lock": "build", "pipfile": "build", "pipfile.lock": "build", "gemfile": "build", "gemfile.lock": "build", "composer.json": "build", "composer.lock": "build", "pom.xml": "build", "build.gradle": "build", "cargo.toml": "build", "cargo.lock": "build", "makefile": "build", "cmake.txt": "build",
}
TEST_MARKS = [".test.", ".spec.", "_test.", "/test/", "/tests/", "__test__", "__tests__"]

FRAMEWORK_MARKS = {
    "react": ["import react", "from 'react'", 'from "react"', "usestate", "useeffect"], "vue": ["vue.component", "new vue", "@vue/", "vue-"], "angular": ["@angular/", "@component", "@injectable", "ngmodule"],
    "express": ["express()", "app.get(", "app.post(", "require('express')"], "fastapi": ["from fastapi", "fastapi()", "@app.get", "@app.post"], "django": ["from django", "django.", "models.model", "django.conf"],
    "flask": ["from flask", "flask()", "@app.route"], "spring": ["@controller", "@service", "@repository", "@autowired"], "laravel": ["illuminate\\", "artisan", "eloquent"], "rails": ["activerecord", "actioncontroller", "rails.application"],
    "jquery": ["$(", "jquery", ".ready("], "bootstrap": ["bootstrap", "btn-", "col-", "row"], "tailwind": ["tailwind", "tw-", "bg-", "text-"], "material-ui": ["@mui/", "@material-ui/", "makeStyles"],
    "styled-components": ["styled-components", "styled."], "redux": ["redux", "createstore", "useselector", "usedispatch"], "tensorflow": ["tensorflow", "tf.", "keras"], "pytorch": ["torch", "pytorch", "nn.module"],
    "numpy": ["import numpy", "np."], "pandas": ["import pandas", "pd."], "unittest": ["import unittest", "testcase"], "pytest": ["import pytest", "@pytest."], "jest": ["describe(", "it(", "expect("],
}
FRAMEWORK_SIGNATURES = {
    "react": ["usestate", "useeffect", "jsx", "react.component"], "vue": ["vue.component", "template>", "@click", "v-if"], "angular": ["@component", "@injectable", "ngmodule", "ngoninit"], "express": ["app.get", "app.post", "express()", "router."],
    "flask": ["@app.route", "flask()", "request."], "django": ["models.model", "views.view", "urls.py", "django."], "spring": ["@controller", "@service", "@autowired", "@requestmapping"], "laravel": ["route::", "eloquent", "blade.php", "artisan"],
}
FRAMEWORK_INDICATORS = {
    "fastapi": ["from fastapi", "FastAPI", "APIRouter", "@app.route"], "django": ["from django", "django.contrib", "models.Model", "views.py"], "flask": ["from flask", "Flask", "@app.route", "request."],
    "react": ["import React", "useState", "useEffect", ".jsx", ".tsx"], "vue": ["vue", "createApp", ".vue"], "angular": ["@angular", "@Component", "angular.json"], "express": ["express", "app.get", "app.post", "middleware"],
    "spring": ["@SpringBootApplication", "@RestController", "@Service"], "laravel": ["<?php", "Illuminate\\", "artisan"],
}
SECURITY_WORDS = ["password", "secret", "api_key", "private_key", "token", "todo", "fixme", "hack", "xxx"]
EXCLUDED_DIRECTORIES = [
    ".git", "__pycache__", "venv", "node_modules", ".vscode", ".idea", "dist", "build", ".pytest_cache", ".mypy_cache", ".tox", "target", "bin", "obj", "out", ".gradle", ".mvn", "vendor", "deps", "_build", ".stack-work", ".cabal-sandbox", "elm-stuff", ".pub-cache", ".dart_tool",
]
SERVICE_TYPES = {
    "postgres": "database", "mysql": "database", "mongodb": "database", "redis": "cache", "memcached": "cache", "nginx": "web_server", "apache": "web_server", "rabbitmq": "message_queue", "kafka": "message_queue",
    "elasticsearch": "search", "solr": "search", "prometheus": "monitoring", "grafana": "monitoring", "jaeger": "tracing", "zipkin": "tracing",
}
ADVISORY_ECOSYSTEMS = {"python": "PyPI", "javascript": "npm", "java": "Maven", "go": "Go", "rust": "crates.io", "php": "Packagist", "ruby": "RubyGems", "nuget": "NuGet"}
LICENSE_POLICY = {
    "MIT": "allow",
    "Apache-2.0": "allow",
    "BSD-3-Clause": "allow",
    "BSD-2-Clause": "allow",
    "ISC": "allow",
    "GPL-3.0": "deny",
    "AGPL-3.0": "deny",
    "SSPL-1.0": "deny",
    "GPL-2.0": "restrict",
    "LGPL-3.0": "restrict",
}
LANGUAGE_WEIGHTS = {
    "python": 10, "javascript": 9, "typescript": 9, "java": 8, "csharp": 8, "go": 7, "rust": 7, "swift": 6, "cpp": 6, "ruby": 5, "php": 5, "dart": 4, "kotlin": 4, "haskell": 3, "elixir": 3, "clojure": 3,
}
#: Ecosystems in the order in which they are tried: files at the root, extensions anywhere, build tools.
ECOSYSTEMS = {
    "python": (["requirements.txt", "pyproject.toml", "setup.py", "Pipfile", "poetry.lock", "conda.yml", "environment.yml", "setup.cfg"], [".py"], ["pip", "poetry", "pipenv", "conda"]),
    "node": (["package.json"], [".js", ".ts", ".jsx", ".tsx"], ["npm", "yarn", "pnpm"]),
    "java": (["pom.xml", "build.gradle", "build.gradle.kts", "gradle.properties"], [".java"], ["maven", "gradle"]),
    "dotnet": (["*.csproj", "*.vbproj", "*.fsproj", "*.sln", "global.json"], [".cs", ".vb", ".fs"], ["dotnet"]),
    "go": (["go.mod", "go.sum"], [".go"], ["go"]),
    "rust": (["Cargo.toml", "Cargo.lock"], [".rs"], ["cargo"]),
    "cpp": (["CMakeLists.txt", "Makefile", "makefile", "meson.build", "conanfile.txt"], [".c", ".cpp", ".cxx", ".cc", ".h", ".hpp"], ["cmake", "make", "meson", "conan"]),
    "swift": (["Package.swift", "*.xcodeproj", "*.xcworkspace"], [".swift"], ["swift", "xcodebuild"]),
    "ruby": (["Gemfile", "Gemfile.lock", "Rakefile", "*.gemspec"], [".rb"], ["bundler", "rake", "gem"]),
    "php": (["composer.json", "composer.lock"], [".php"], ["composer"]),
    "dart": (["pubspec.yaml", "pubspec.lock"], [".dart"], ["pub", "flutter"]),
    "kotlin": (["build.gradle.kts"], [".kt", ".kts"], ["gradle"]),
    "scala": (["build.sbt", "project/build.properties"], [".scala"], ["sbt"]),
    "clojure": (["project.clj", "deps.edn", "build.boot"], [".clj", ".cljs", ".cljc"], ["leiningen", "clojure"]),
    "haskell": (["*.cabal", "stack.yaml", "cabal.project"], [".hs", ".lhs"], ["cabal", "stack"]),
    "elixir": (["mix.exs", "mix.lock"], [".ex", ".exs"], ["mix"]),
    "r": (["DESCRIPTION", "renv.lock", ".Rprofile"], [".r", ".R"], ["R"]),
}
ECOSYSTEM_PRIORITY = ["python", "node", "java", "dotnet", "go", "rust", "cpp", "swift"]
CONFIG_PATTERNS = {
    "package_managers": ["package.json", "pyproject.toml", "Cargo.toml", "pom.xml"], "docker": ["Dockerfile*", "docker-compose*.yml", "docker-compose*.yaml"], "ci_cd": [".github/workflows/*.yml", ".gitlab-ci.yml", "Jenkinsfile"],
    "environment": [".env*", "config/*.yml", "config/*.yaml"], "build_tools": ["webpack.config.js", "vite.config.js", "rollup.config.js"],
}
