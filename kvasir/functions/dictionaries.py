"""Dictionaries of fixed values: the built-in tags, and the dependencies that tell a project's stack."""

# Canonical tag, aliases, category, parent.
TAXONOMY = [
    ("typescript", ("ts", "tsc"), "technology", None),
    ("javascript", ("js", "ecmascript", "es6", "es2015", "es2020"), "technology", None),
    ("python", ("py", "python3"), "technology", None),
    ("rust", ("rs", "rustlang"), "technology", None),
    ("go", ("golang",), "technology", None),
    ("java", ("jvm",), "technology", None),
    ("csharp", ("c#", "dotnet", ".net"), "technology", None),
    ("react", ("reactjs", "react-js", "react.js"), "technology", None),
    ("nextjs", ("next", "next-js", "next.js"), "technology", "react"),
    ("vue", ("vuejs", "vue-js", "vue.js"), "technology", None),
    ("angular", ("angularjs", "ng"), "technology", None),
    ("svelte", ("sveltejs", "sveltekit"), "technology", None),
    ("tailwind", ("tailwindcss", "tailwind-css"), "technology", None),
    ("nodejs", ("node", "node-js", "node.js"), "technology", None),
    ("express", ("expressjs", "express-js", "express.js"), "technology", "nodejs"),
    ("fastify", ("fastify-js",), "technology", "nodejs"),
    ("nestjs", ("nest", "nest-js"), "technology", "nodejs"),
    ("django", (), "technology", "python"),
    ("flask", (), "technology", "python"),
    ("fastapi", ("fast-api",), "technology", "python"),
    ("postgresql", ("postgres", "pg", "psql"), "technology", None),
    ("mysql", ("mariadb",), "technology", None),
    ("mongodb", ("mongo",), "technology", None),
    ("redis", (), "technology", None),
    ("sqlite", ("sqlite3",), "technology", None),
    ("elasticsearch", ("elastic", "es"), "technology", None),
    ("kubernetes", ("k8s", "kube"), "technology", None),
    ("docker", ("containers", "containerization"), "technology", None),
    ("aws", ("amazon-web-services",), "technology", None),
    ("gcp", ("google-cloud", "google-cloud-platform"), "technology", None),
    ("azure", ("microsoft-azure",), "technology", None),
    ("terraform", ("tf", "iac"), "technology", None),
    ("git", ("github", "gitlab", "version-control", "vcs"), "technology", None),
    ("graphql", ("gql",), "technology", None),
    ("rest-api", ("rest", "restful", "rest-api"), "technology", None),
    ("grpc", ("g-rpc",), "technology", None),
    ("authentication", ("auth", "authn"), "concept", None),
    ("authorization", ("authz", "permissions", "rbac", "acl"), "concept", None),
    ("caching", ("cache", "memoization"), "concept", None),
    ("api-design", ("api-architecture",), "concept", None),
    ("testing", ("tests", "unit-tests", "test", "tdd"), "concept", None),
    ("security", ("sec", "infosec", "cybersecurity"), "concept", None),
    ("performance", ("perf", "optimization", "optimisation"), "concept", None),
    ("dependency-injection", ("di", "ioc", "inversion-of-control"), "concept", None),
    ("error-handling", ("exceptions", "error-management", "errors"), "concept", None),
    ("logging", ("logs", "observability"), "concept", None),
    ("monitoring", ("metrics", "alerting", "apm"), "concept", None),
    ("database-design", ("schema-design", "data-modeling"), "concept", None),
    ("event-driven", ("events", "event-sourcing", "cqrs", "pub-sub"), "concept", None),
    ("microservices", ("micro-services",), "concept", None),
    ("solid-principles", ("solid", "design-principles"), "concept", None),
    ("clean-code", ("code-quality", "clean-architecture"), "concept", None),
    ("type-safety", ("type-checking", "static-typing"), "concept", None),
    ("concurrency", ("async", "parallelism", "multithreading"), "concept", None),
    ("payments", ("billing", "checkout", "stripe", "payment-processing"), "domain", None),
    ("user-management", ("users", "accounts", "profiles"), "domain", None),
    ("notifications", ("alerts", "push-notifications", "email-notifications"), "domain", None),
    ("file-upload", ("uploads", "file-storage", "s3-upload"), "domain", None),
    ("search", ("full-text-search", "search-engine"), "domain", None),
    ("analytics", ("tracking", "reporting", "dashboards"), "domain", None),
    ("messaging", ("chat", "real-time", "websockets"), "domain", None),
    ("scheduling", ("cron", "jobs", "background-tasks", "queues"), "domain", None),
    ("internationalization", ("i18n", "localization", "l10n"), "domain", None),
    ("e-commerce", ("ecommerce", "shopping-cart", "orders"), "domain", None),
    ("media", ("images", "video", "audio", "media-processing"), "domain", None),
    ("ai-ml", ("machine-learning", "artificial-intelligence", "llm"), "domain", None),
    ("refactoring", ("refactor", "cleanup", "code-cleanup"), "action", None),
    ("migration", ("migrate", "upgrade", "data-migration"), "action", None),
    ("bugfix", ("fix", "bug", "hotfix", "patch"), "action", None),
    ("feature", ("new-feature", "enhancement"), "action", None),
    ("documentation", ("docs", "readme", "doc"), "action", None),
    ("deprecation", ("deprecated", "sunset"), "action", None),
    ("debugging", ("debug", "troubleshooting"), "action", None),
    ("configuration", ("config", "settings", "setup"), "action", None),
    ("deployment", ("deploy", "release", "ci-cd"), "action", None),
    ("review", ("code-review", "pr-review"), "action", None),
]

# Part of the stack, its name, and the dependencies that tell it; of each part the first that is found.
STACK = [
    ("framework", "Next.js", ("next",)), ("framework", "Nuxt", ("nuxt",)), ("framework", "Remix", ("@remix-run/react", "@remix-run/node")), ("framework", "SvelteKit", ("@sveltejs/kit",)),
    ("framework", "Svelte", ("svelte",)), ("framework", "Astro", ("astro",)), ("framework", "SolidJS", ("solid-js", "solid-start")), ("framework", "Angular", ("@angular/core",)),
    ("framework", "Vue", ("vue",)), ("framework", "React", ("react",)), ("framework", "Hono", ("hono",)), ("framework", "Fastify", ("fastify",)), ("framework", "Express", ("express",)),
    ("framework", "Koa", ("koa",)), ("framework", "NestJS", ("@nestjs/core",)), ("framework", "Elysia", ("elysia",)),
    ("database", "Prisma", ("prisma", "@prisma/client")), ("database", "Drizzle", ("drizzle-orm",)), ("database", "TypeORM", ("typeorm",)), ("database", "Sequelize", ("sequelize",)),
    ("database", "Mongoose (MongoDB)", ("mongoose",)), ("database", "LibSQL/Turso", ("@libsql/client", "libsql")), ("database", "SQLite", ("better-sqlite3", "sql.js")),
    ("database", "PostgreSQL", ("pg", "postgres")), ("database", "MySQL", ("mysql2", "mysql")), ("database", "Redis", ("redis", "ioredis")), ("database", "Supabase", ("@supabase/supabase-js",)),
    ("database", "Firebase", ("firebase", "firebase-admin")),
    ("auth", "Better Auth", ("better-auth",)), ("auth", "Auth.js (NextAuth)", ("next-auth", "@auth/core")), ("auth", "Clerk", ("@clerk/nextjs", "@clerk/clerk-sdk-node")), ("auth", "Lucia", ("lucia",)),
    ("auth", "Supabase Auth", ("@supabase/auth-helpers-nextjs",)), ("auth", "Passport.js", ("passport",)), ("auth", "Kinde", ("@kinde-oss/kinde-auth-nextjs",)), ("auth", "Auth0", ("auth0",)),
    ("testing", "Vitest", ("vitest",)), ("testing", "Jest", ("jest",)), ("testing", "Playwright", ("@playwright/test",)), ("testing", "Cypress", ("cypress",)),
    ("testing", "React Testing Library", ("@testing-library/react",)), ("testing", "Mocha", ("mocha",)), ("testing", "AVA", ("ava",)),
]
# Files that tell the runtime, first found first; folders of the app router; files of a configured database.
RUNTIME = [("bun.lockb", "Bun"), ("bun.lock", "Bun"), ("pnpm-lock.yaml", "Node.js (pnpm)"), ("yarn.lock", "Node.js (yarn)"), ("package-lock.json", "Node.js (npm)"), ("deno.json", "Deno")]
APP_ROUTER = ("app", "src/app")
CONFIGURED = [("Prisma", "prisma/schema.prisma"), ("Drizzle", "drizzle.config.ts")]
